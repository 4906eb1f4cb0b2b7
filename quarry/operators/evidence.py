"""Evidence operators over events(source, line_no, byte_off, total_bytes, ts, level, msg, fields, raw)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import parse
from quarry.functions import patterns as P


def fold(lines: DataFrame, run: int = 1 << 16) -> DataFrame:
    """Add head_no, the line of the event a line belongs to. Runs of lines are folded apart and joined at their edges."""
    cont = parse.is_continuation(F.col("raw"))
    marked = lines.withColumn("head", F.when(~cont & (F.trim("raw") != ""), F.col("line_no"))).withColumn("run", F.expr(f"line_no div {run}"))
    edges = marked.groupBy("source", "run").agg(F.max("head").alias("last"))
    carry = edges.select("source", "run", F.max("last").over(Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    inside = F.max("head").over(Window.partitionBy("source", "run").orderBy("line_no"))
    return marked.withColumn("inside", inside).join(carry, ["source", "run"]).withColumn("head_no", F.coalesce("inside", "carry")).drop("head", "inside", "carry", "run")


def sniff(lines: DataFrame) -> str:
    """json, logfmt or text, from the first 60 lines."""
    toks = F.split(F.trim("raw"), r"\s+")
    pairs = F.size(F.filter(toks, lambda t: t.rlike(r"^\w[\w.\-]*=")))
    js = F.trim("raw").startswith("{") & F.trim("raw").endswith("}")
    one = lines.filter("line_no <= 60").agg(F.count_if(js).alias("js"), F.count_if(~js & (F.size(toks) >= 3) & (pairs > 0.6 * F.size(toks))).alias("lf")).first()
    total = max(1, one.js + one.lf)
    return "json" if one.js >= 3 and one.js / total > 0.6 else "logfmt" if one.lf >= 3 and one.lf / total > 0.6 else "text"


def events(lines: DataFrame, kind: str | None = None, year: int = 2000) -> DataFrame:
    """Heads of folded events, parsed. Lines that know their head already (``head_no``) aren't folded again."""
    kind = kind or sniff(lines)
    inner = lines.withColumn("env", parse.envelope(F.col("raw"))).withColumn("raw", F.col("env.inner")).filter(F.trim("raw") != "")
    heads = (inner if "head_no" in lines.columns else fold(inner)).filter("head_no = line_no")
    empty = F.create_map().cast("map<string,string>")
    if kind == "text":
        stamps = [F.col("env.ts"), F.col("raw")]
        return heads.withColumns({"fields": empty, "level": parse.text_level(F.col("raw")), "msg": F.col("raw"), "ts": parse.log_time(stamps, year)}).drop("env", "head_no")
    fields = {"json": parse.json_fields, "logfmt": parse.logfmt_fields}[kind](F.col("raw"))

    def picked(f: Column) -> Column:
        return F.struct(f.alias("all"), *[parse.role_key(f, names).alias(name) for name, names in (("level", P.LEVEL_KEYS), ("msg", P.MESSAGE_KEYS), ("ts", P.TIME_KEYS))])

    def split(k: Column) -> Column:
        # only the fields that were picked go; others of the same kind stay
        other = lambda name: ~F.coalesce(name == k["level"], F.lit(False)) & ~F.coalesce(name == k["msg"], F.lit(False)) & ~F.coalesce(name == k["ts"], F.lit(False))
        roles = [F.try_element_at(k["all"], k[r]).alias(r) for r in ("level", "msg", "ts")]
        return F.struct(F.map_filter(k["all"], lambda name, _: other(name)).alias("fields"), *roles)

    out = heads.withColumn("parsed", parse.once(F.coalesce(fields, empty), lambda f: parse.once(picked(f), split)))
    level = F.coalesce(F.upper(F.col("parsed.level")), parse.text_level(F.col("raw")))
    stamps = [F.col("env.ts"), F.col("parsed.ts"), F.col("raw")]
    out = out.withColumns({"fields": F.col("parsed.fields"), "level": level, "msg": F.coalesce("parsed.msg", "raw"), "ts": parse.log_time(stamps, year)})
    return out.drop("env", "head_no", "parsed")


def samples(lines: DataFrame, most: int = 6, size: int = 300) -> DataFrame:
    """line_no, sample: each event's head with up to ``most`` continuations, cut to ``size``."""
    folded = (lines if "head_no" in lines.columns else fold(lines)).filter("head_no is not null")
    rest = F.when((F.col("line_no") > F.col("head_no")) & (F.col("line_no") <= F.col("head_no") + most), F.struct("line_no", F.substring(F.trim("raw"), 1, size).alias("text")))
    head = F.max(F.when(F.col("line_no") == F.col("head_no"), F.substring("raw", 1, size)))
    out = folded.groupBy("source", "head_no").agg(head.alias("head"), F.array_sort(F.collect_list(rest)).alias("rest"))
    joined = F.concat_ws(" | ", F.col("head"), F.transform("rest", lambda x: x["text"]))
    return out.select("source", F.col("head_no").alias("line_no"), F.substring(joined, 1, size).alias("sample"))


def probed(ev: DataFrame) -> DataFrame:
    """Add probe, signal, frac, bucket."""
    probe = F.concat(F.coalesce("level", F.lit("")), F.lit(" "), "msg")
    frac = F.col("byte_off") / F.col("total_bytes")
    return ev.withColumn("probe", probe).withColumn("signal", parse.is_signal(F.col("level"), F.col("probe"))).withColumn("frac", frac).withColumn("bucket", F.least(F.floor(frac * P.DENSITY_BUCKETS), F.lit(P.DENSITY_BUCKETS - 1)).cast("long"))


def templates(ev: DataFrame, template: Column | None = None) -> DataFrame:
    """template -> cnt, first_off, first_frac, sample, sample_signal, sample_change."""
    keyed = ev.withColumn("template", template if template is not None else parse.template(F.col("probe")))
    out = keyed.groupBy("template").agg(F.count(F.lit(1)).alias("cnt"), F.min("byte_off").alias("first_off"), F.min("frac").alias("first_frac"), F.substring(F.min_by("msg", "byte_off"), 1, 300).alias("sample"))
    return out.withColumn("sample_signal", F.lower("sample").rlike(P.SIGNAL)).withColumn("sample_change", F.col("sample").rlike(P.CHANGE))


def density(ev: DataFrame) -> DataFrame:
    counts = ev.filter("signal").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    spine = ev.sparkSession.range(P.DENSITY_BUCKETS).withColumnRenamed("id", "bucket")
    return spine.join(F.broadcast(counts), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def onset(tpl: DataFrame) -> DataFrame:
    """The first new signal template, one row or none."""
    return tpl.filter((F.col("first_frac") > P.NEW_AFTER) & F.col("sample_signal")).orderBy("first_off").limit(1).select("first_off", "first_frac", "template")


def patterns(tpl: DataFrame, k: int = 18) -> DataFrame:
    """Commonest signal templates."""
    return tpl.filter("sample_signal").orderBy(F.col("cnt").desc(), "first_off").limit(k).select("template", "cnt", "first_frac", (F.col("first_frac") > P.NEW_AFTER).alias("is_new"))


def rare(tpl: DataFrame, k: int = 18) -> DataFrame:
    """Near-unique events, scored by rarity, nearness before the onset, change words and signal words."""
    new = (F.col("first_frac") > P.NEW_AFTER) & F.col("sample_signal")
    about = tpl.agg(F.sum("cnt").alias("total"), F.min(F.when(new, F.struct("first_off", "first_frac")))["first_frac"].alias("onset"))
    few = tpl.join(F.broadcast(about), F.lit(True)).filter((F.col("cnt") <= F.greatest(F.lit(3), F.floor(F.col("total") * 0.002))) & (F.col("sample") != ""))
    gap = F.col("onset") - F.col("first_frac")
    near = F.when((gap >= 0) & (gap < 0.35), 3 * (1 - gap / 0.35)).when(gap < 0, F.lit(0.4)).otherwise(F.lit(0.0))
    score = 3 / (F.col("cnt") + 1) + near + F.when(F.col("sample_change"), 1.5).otherwise(0.0) - F.when(F.col("sample_signal"), 0.8).otherwise(0.0)
    relation = F.when(gap >= 0, F.lit("before")).when(gap < 0, F.lit("after"))
    return few.withColumn("score", score).withColumn("relation", relation).orderBy(F.col("score").desc(), "first_off").limit(k).select("template", "cnt", "score", "relation")


def pairs(ev: DataFrame, pattern: str, fields: bool = True, number: str | None = None) -> DataFrame:
    """Fields and regex pairs of the line without its envelope together, as a bag: line_no, signal, key, value."""
    value = lambda x: F.substring(x, F.locate("=", x) + 1, F.length(x))
    cut = (lambda x: F.regexp_extract(value(x), number, 0)) if number else value
    # one match a pair; what is a key and what a value follows from its first "="
    texts = F.transform(F.regexp_extract_all("raw", F.lit(pattern), F.lit(0)), lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), cut(x).alias("value")))
    both = F.concat(F.transform(F.map_entries("fields"), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))), texts) if fields else texts
    return ev.select("line_no", "signal", F.explode(both).alias("x")).select("line_no", "signal", F.col("x.key").alias("key"), F.col("x.value").alias("value"))


NUMBER = r"^-?\d+(\.\d+)?$"


def series(ev: DataFrame) -> DataFrame:
    """key, line_no, num."""
    out = pairs(ev, P.NUMBER_PAIR, number=r"^\d+(?:\.\d+)?").filter(F.col("value").rlike(NUMBER) & ~F.lower("key").isin(*P.SERIES_SKIP))
    return out.select("key", "line_no", F.col("value").cast("double").alias("num"))


def ordinals(points: DataFrame, run: int = 1 << 16) -> DataFrame:
    """Add rn, a point's place among its key's, and n, their number. Runs of lines are counted apart, so that a hot key's points come from many tasks."""
    dealt = points.withColumn("run", F.expr(f"line_no div {run}"))
    sums = dealt.groupBy("key", "run").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("key", "run", before.alias("before"), F.sum("c").over(Window.partitionBy("key")).alias("n"))
    inside = F.row_number().over(Window.partitionBy("key", "run").orderBy("line_no"))
    return dealt.withColumn("inside", inside).join(starts, ["key", "run"]).withColumn("rn", F.col("before") + F.col("inside")).drop("run", "inside", "before")


def trends(points: DataFrame, k: int = 12) -> DataFrame:
    """Mean of each key's first quarter of points against its last."""
    ranked = ordinals(points).filter(f"n >= {P.TREND_POINTS}").withColumn("q", F.greatest(F.expr("n div 4"), F.lit(1)))
    means = ranked.groupBy("key", "n").agg(F.min("line_no").alias("first_line"), F.avg(F.when(F.col("rn") <= F.col("q"), F.col("num"))).alias("head_avg"), F.avg(F.when(F.col("rn") > F.col("n") - F.col("q"), F.col("num"))).alias("tail_avg"))
    ratio = (F.col("tail_avg") + 1e-9) / (F.col("head_avg") + 1e-9)
    out = means.filter("head_avg <> 0 or tail_avg <> 0").withColumn("ratio", ratio).filter("ratio >= 1.5 or ratio <= 0.66").withColumn("direction", F.when(F.col("ratio") > 1, "GREW").otherwise("DROPPED"))
    return out.orderBy(F.greatest(F.col("ratio"), 1 / F.col("ratio")).desc(), "first_line", "key").limit(k).select("key", "n", "head_avg", "tail_avg", "ratio", "direction")


def decimated(points: DataFrame, most: int = 100) -> DataFrame:
    """Every 2^j-th point of a key, with the least j that leaves at most ``most``."""
    stride = F.expr(f"cast(pow(2, ceil(greatest(log2(n / {most}), 0))) as bigint)")
    return ordinals(points).filter((F.col("rn") - 1) % stride == 0).select("key", "line_no", "num")


def dim_counts(ev: DataFrame) -> DataFrame:
    """(dim, value) -> all_n, err_n."""
    structured = ev.select("signal", F.explode("fields").alias("key", "value")).filter(~F.col("value").rlike(NUMBER) | F.lower("key").isin(*P.NUMERIC_DIMS)).withColumn("value", F.substring("value", 1, 40))
    texts = pairs(ev, P.DIM_PAIR, fields=False).filter(~F.lower("key").isin(*P.DIM_SKIP) & (~F.col("value").rlike(r"^\d+$") | F.lower("key").isin(*P.NUMERIC_DIMS))).select("signal", "key", "value")
    return structured.unionByName(texts).groupBy(F.col("key").alias("dim"), "value").agg(F.count(F.lit(1)).alias("all_n"), F.count_if("signal").alias("err_n"))


def dims(counts: DataFrame, k: int = 5, values: int = 4) -> DataFrame:
    """Distribution of errors over inferred dimensions; a distribution, not a ranking of suspects."""
    sums = counts.groupBy("dim").agg(F.count(F.lit(1)).alias("kinds"), F.sum("all_n").alias("all_t"), F.sum("err_n").alias("err_t")).filter("kinds between 2 and 50 and err_t >= 10")
    top = sums.orderBy(F.col("err_t").desc(), "dim").limit(k)
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.col("err_n").desc(), "value"))
    out = counts.filter("err_n > 0").join(F.broadcast(top), "dim").withColumn("value_rank", rank).filter(F.col("value_rank") <= values)
    return out.select("dim", "value", "err_n", "all_n", F.bround(100 * F.col("err_n") / F.col("err_t")).alias("err_pct"), F.bround(100 * F.col("all_n") / F.col("all_t")).alias("base_pct"), F.col("value_rank").cast("long").alias("value_rank"))


def context(lines: DataFrame, at: int | None, around: int = P.CONTEXT, source: str | None = None, before_bytes: int = 4000) -> DataFrame:
    """Raw lines around the onset, of its source; those before it begin at most ``before_bytes`` back, where lines have offsets."""
    if at is None:
        return lines.limit(0)
    near = lines.filter(F.col("line_no").between(at - around, at + around - 1))
    if source is not None:
        near = near.filter(F.col("source") == source)
    if "byte_off" in lines.columns:
        onset_at = F.broadcast(near.filter(F.col("line_no") == at).agg(F.max("byte_off").alias("onset_off")))
        near = near.join(onset_at, F.lit(True)).filter(F.col("byte_off") >= F.col("onset_off") - before_bytes).drop("onset_off")
    return near.orderBy("line_no")


def is_sorted(lines: DataFrame, run: int = 1 << 16) -> DataFrame:
    """Per source: whether dated lines are in order of time, by runs and the runs' edges; without two dates they are."""
    dated = lines.filter("ts is not null").withColumn("run", F.expr(f"line_no div {run}"))
    inside = dated.withColumn("ok", F.coalesce(F.col("ts") >= F.lag("ts").over(Window.partitionBy("source", "run").orderBy("line_no")), F.lit(True)))
    edges = inside.groupBy("source", "run").agg(F.min_by("ts", "line_no").alias("first"), F.max_by("ts", "line_no").alias("last"), F.bool_and("ok").alias("ok"), F.count(F.lit(1)).alias("n"))
    joined = edges.withColumn("ok", F.col("ok") & F.coalesce(F.col("first") >= F.lag("last").over(Window.partitionBy("source").orderBy("run")), F.lit(True)))
    return joined.groupBy("source").agg(F.bool_and("ok").alias("sorted"), F.sum("n").alias("dated"))


def change_markers(ev: DataFrame) -> DataFrame:
    """bucket, marked: density positions that hold a line of a deployment, flag or other change."""
    marked = ev.filter(F.col("msg").rlike(P.CHANGE)).select("bucket").distinct().withColumn("marked", F.lit(True))
    spine = ev.sparkSession.range(P.DENSITY_BUCKETS).withColumnRenamed("id", "bucket")
    return spine.join(F.broadcast(marked), "bucket", "left").select("bucket", F.coalesce("marked", F.lit(False)).alias("marked"))


def tail(lines: DataFrame, n: int = 30) -> DataFrame:
    return lines.orderBy(F.col("line_no").desc()).limit(n)


def slice_window(ev: DataFrame, since=None, until=None, last_seconds: float | None = None) -> DataFrame:
    """Inclusive; undated lines stay. ``last_seconds`` counts back from the latest time."""
    cond = F.lit(True)
    if last_seconds is not None:
        latest = F.broadcast(ev.agg(F.max("ts").alias("latest")))
        ev = ev.join(latest, F.lit(True))
        cond = F.unix_micros(F.col("ts").cast("timestamp")) >= F.unix_micros(F.col("latest").cast("timestamp")) - int(last_seconds * 1_000_000)
    elif since is not None:
        cond = F.col("ts") >= F.lit(since).cast("timestamp_ntz")
    if until is not None:
        cond = cond & (F.col("ts") <= F.lit(until).cast("timestamp_ntz"))
    return ev.filter(F.col("ts").isNull() | cond).drop("latest")


def seconds(duration: str) -> float:
    """'30m', '1.5h', '7d' in seconds."""
    import re

    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([smhdw])\s*", duration, re.I)
    if not m:
        raise ValueError(f"bad duration {duration!r}: use 30m, 2h, 7d")
    return float(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}[m[2].lower()]


def vocabulary(lines: DataFrame, least: int = 20) -> DataFrame:
    """Words common enough to belong to the system, and those always kept."""
    w = lines.select(F.explode(F.regexp_extract_all("raw", F.lit(P.WORD), F.lit(0))).alias("word"))
    common = w.groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("word")
    return common.union(lines.sparkSession.createDataFrame([(x,) for x in P.KEEP_WORDS], "word string")).distinct()


#: Up to so many words go to every task.
MOST_WORDS = 20_000


def redact(lines: DataFrame, least: int = 20) -> DataFrame:
    """Structure-preserving redaction: raw becomes redacted; a leading time stays. Words are looked up where they stand while the vocabulary is small, beyond that by an anti join."""
    head = F.regexp_extract("raw", P.WIDE + P.TIME_HEAD, 0)
    clean = lines.withColumn("head", head).withColumn("clean", parse.placeholders(F.substring("raw", F.length("head") + 1, F.length("raw"))))
    piece = P.PLACEHOLDER + "|" + P.WORD  # placeholders first, so that no word is looked for in them
    digits = lambda x: F.regexp_replace(x, P.WIDE + r"\d", "9")

    def rewritten(is_rare) -> Column:
        shown = lambda x: F.when(x.startswith("<"), x).when(is_rare(x), F.lit("<w>")).otherwise(digits(x))
        return F.concat("head", parse.rewritten(F.col("clean"), piece, shown, digits))

    words = vocabulary(lines, least)
    known = [r.word for r in words.limit(MOST_WORDS + 1).collect()]
    if len(known) <= MOST_WORDS:
        return clean.withColumn("redacted", rewritten(lambda x: ~F.lower(x).isin(*known))).drop("head", "clean")
    found = F.filter(F.regexp_extract_all("clean", F.lit(piece), F.lit(0)), lambda x: ~x.startswith("<"))
    w = clean.select("source", "line_no", F.explode(F.array_distinct(found)).alias("w")).withColumn("word", F.lower("w"))
    unknown = w.join(words, "word", "left_anti").groupBy("source", "line_no").agg(F.collect_set("w").alias("rare"))
    rare = F.coalesce("rare", F.array().cast("array<string>"))
    return clean.join(unknown, ["source", "line_no"], "left").withColumn("redacted", rewritten(lambda x: F.array_contains(rare, x))).drop("head", "clean", "rare")


def health(lines: DataFrame, k: int = 6) -> DataFrame:
    """Parse rates and commonest levels over all non-blank lines, without content. ``levels``: at most ``k`` of (level, n), those seen first ahead of equals."""
    seen = lines.filter(F.trim("raw") != "").select("line_no", parse.time_text(F.col("raw"))["text"].isNotNull().alias("dated"), parse.text_level(F.col("raw")).alias("level"))
    by_level = seen.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count_if("dated").alias("dated"), F.min("line_no").alias("first"))  # a handful of rows
    entry = F.when(F.col("level").isNotNull(), F.struct((-F.col("n")).alias("less"), "first", "level", "n"))
    top = F.transform(F.slice(F.array_sort(F.collect_list(entry)), 1, k), lambda x: F.struct(x["level"].alias("level"), x["n"].alias("n")))
    total = F.coalesce(F.sum("n"), F.lit(0))
    leveled = F.coalesce(F.sum(F.when(F.col("level").isNotNull(), F.col("n"))), F.lit(0))
    rate = lambda x: F.when(total > 0, 100.0 * x / total)
    return by_level.agg(total.alias("lines"), rate(F.sum("dated")).alias("ts_pct"), rate(leveled).alias("level_pct"), top.alias("levels"))


def health_report(lines: DataFrame, first: int = 20_000, k: int = 5) -> DataFrame:
    """One row: format, health over every line, and the shapes of the first non-blank lines."""
    head = lines.filter(F.trim("raw") != "").orderBy("line_no").limit(first)
    top = shapes(head, k).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "shape", "n"))).alias("s"))
    top = top.select(F.transform("s", lambda x: F.struct(x["shape"].alias("shape"), x["n"].alias("n"))).alias("shapes"))
    return health(lines).select(F.lit(sniff(lines)).alias("format"), "*").join(F.broadcast(top), F.lit(True))


def shapes(lines: DataFrame, k: int = 5) -> DataFrame:
    return lines.filter(F.trim("raw") != "").groupBy(parse.shape(F.col("raw")).alias("shape")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "shape").limit(k)


def grouping_accuracy(rows: DataFrame) -> DataFrame:
    """rows(predicted, truth): share of rows whose predicted group is exactly one truth group."""
    size = rows.groupBy("truth").agg(F.count(F.lit(1)).alias("truth_n"))
    cells = rows.groupBy("predicted", "truth").agg(F.count(F.lit(1)).alias("n"))
    groups = cells.groupBy("predicted").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"), F.min("truth").alias("truth"))
    right = groups.join(size, "truth").agg(F.sum(F.when((F.col("kinds") == 1) & (F.col("n") == F.col("truth_n")), F.col("n")).otherwise(0)).alias("good"), F.sum("n").alias("total"))
    return right.select((F.col("good") / F.col("total")).alias("accuracy"))


def service_counts(rows: DataFrame) -> DataFrame:
    """rows(svc, is_error, post): the four counters and the lift."""
    c = rows.groupBy("svc").agg(F.count(F.lit(1)).alias("all_n"), F.count_if("is_error").alias("err_n"), F.count_if("post").alias("post_n"), F.count_if(F.col("post") & F.col("is_error")).alias("post_err_n"))
    t = c.agg(F.sum("all_n").alias("a"), F.sum("err_n").alias("e"))
    return c.join(F.broadcast(t), F.lit(True)).select("svc", "all_n", "err_n", "post_n", "post_err_n", ((F.col("err_n") / F.col("e")) / (F.col("all_n") / F.col("a"))).alias("lift"))


def post_injection(rows: DataFrame, cases: DataFrame, seconds: int = 600) -> DataFrame:
    """rows(case_id, svc, ts, msg) with truth, is_error and post: within ``seconds`` of the case's injection. cases(case_id, truth, inject)."""
    joined = rows.join(F.broadcast(cases), "case_id")
    after = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("inject").cast("timestamp"))
    return joined.withColumn("is_error", F.col("msg").rlike(P.BENCH_ERROR)).withColumn("post", F.coalesce(after.between(0, seconds * 1_000_000), F.lit(False)))


def baselines(rows: DataFrame) -> DataFrame:
    """Per case of post_injection's rows: the services with most errors, most errors after the injection and the highest lift, and the chance of guessing. Equal ones go by name."""
    c = rows.groupBy("case_id", "truth", "svc").agg(F.count(F.lit(1)).alias("all_n"), F.count_if("is_error").alias("err_n"), F.count_if(F.col("is_error") & F.col("post")).alias("post_n"))
    t = c.groupBy("case_id").agg(F.sum("all_n").alias("a"), F.sum("err_n").alias("e"))
    c = c.join(t, "case_id").withColumn("lift", F.when(F.col("e") > 0, (F.col("err_n") / F.col("e")) / (F.col("all_n") / F.col("a"))).otherwise(F.lit(0.0)))
    first = lambda x: F.element_at(F.array_sort(F.collect_list(F.struct((-F.col(x)).alias("less"), "svc"))), 1)["svc"]
    return c.groupBy("case_id", "truth").agg(first("err_n").alias("by_errors"), first("post_n").alias("by_post_errors"), first("lift").alias("by_lift"), (1 / F.count(F.lit(1))).alias("chance"))


def hits(guesses: DataFrame) -> DataFrame:
    """Cases, how many each baseline gets right, and what guessing is expected to."""
    right = lambda c: F.count_if(F.col(c) == F.col("truth")).alias(c)
    return guesses.agg(F.count(F.lit(1)).alias("cases"), right("by_errors"), right("by_post_errors"), right("by_lift"), F.sum("chance").alias("expected"))


def sampled_cases(cases: DataFrame, every: int, first: int) -> DataFrame:
    """Every so many-th case by name, then the first of those."""
    nth = F.row_number().over(Window.orderBy("case_id")) - 1  # a row a case
    return cases.withColumn("nth", nth).filter(F.col("nth") % every == 0).orderBy("case_id").limit(first).drop("nth")


def sweep(lines: DataFrame, ev: DataFrame, tpl: DataFrame, first: int = 5000) -> DataFrame:
    """One row on a corpus: lines, share of the first lines with a time, templates and compression, rare templates."""
    head = lines.filter(F.trim("raw") != "").orderBy("line_no").limit(first).agg((100.0 * F.count_if(parse.is_dated(F.col("raw"))) / F.count(F.lit(1))).alias("ts_pct"))
    total = ev.agg(F.count(F.lit(1)).alias("lines"))
    kinds = tpl.agg(F.count(F.lit(1)).alias("templates"), F.count_if(F.col("cnt") <= 3).alias("rare"))
    return total.join(kinds, F.lit(True)).join(head, F.lit(True)).withColumn("compression", F.col("lines") / F.greatest("templates", F.lit(1)))


def upper_median(rows: DataFrame, col: str, buckets: int = 4096) -> DataFrame:
    """The value at place n div 2. Values are counted once; counts in even steps of value find the step that holds it, and only that step's values are put in order."""
    hist = rows.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    span = F.broadcast(hist.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.expr("sum(c) div 2").alias("skip")))
    step = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets)).otherwise(F.lit(0))
    dealt = hist.join(span, F.lit(True)).withColumn("step", step)
    upto = lambda by: F.sum("c").over(Window.orderBy(by))  # noqa: E731  at most ``buckets`` rows, or the distinct values of one step
    steps = dealt.groupBy("step", "skip").agg(F.sum("c").alias("c")).withColumn("upto", upto("step"))
    there = steps.filter("skip < upto and skip >= upto - c").select(F.col("step").alias("s"), (F.col("skip") - F.col("upto") + F.col("c")).alias("left"))
    values = dealt.join(F.broadcast(there), F.col("step") == F.col("s")).withColumn("upto", upto("v"))
    return values.filter("left < upto and left >= upto - c").select(F.col("v").alias("median"))


def sparkline(points: DataFrame, width: int = 24) -> DataFrame:
    """(key, b, level 0..7): points resampled to a fixed width; buckets overlap where points are few."""
    ranked = ordinals(points).withColumn("i", F.col("rn") - 1)
    lo, hi = "(b * n) div {w}".format(w=width), "greatest((b * n) div {w} + 1, ((b + 1) * n) div {w})".format(w=width)
    first = f"greatest(0, (i * {width}) div n - 1)"
    last = f"least({width - 1}, ((i + 1) * {width}) div n + 1)"
    dealt = ranked.withColumn("b", F.explode(F.expr(f"sequence({first}, {last})"))).filter(F.expr(f"i >= {lo} and i < {hi}"))
    means = dealt.groupBy("key", "b").agg(F.avg("num").alias("v"))
    span = means.groupBy("key").agg(F.min("v").alias("mn"), F.max("v").alias("mx"))
    level = F.when(F.col("mx") > F.col("mn"), F.floor((F.col("v") - F.col("mn")) / (F.col("mx") - F.col("mn")) * 7.999)).otherwise(F.lit(0))
    return means.join(F.broadcast(span), "key").select("key", F.col("b").cast("long").alias("b"), level.cast("long").alias("level"))
