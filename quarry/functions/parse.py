"""Line parsing as Catalyst expressions: envelope, time, level, message, fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import patterns as P


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def matched(text: Column, pattern: str, group: int = 0) -> Column:
    return once(F.regexp_extract(text, pattern, group), lambda x: F.when(x != "", x))


def envelope(raw: Column) -> Column:
    """struct<inner, ts, stream> without a container's wrapper."""
    docker = raw.startswith('{"log":') | (raw.startswith("{") & F.substring(raw, 1, 60).contains('"stream"'))
    log = F.when(docker, F.get_json_object(raw, "$.log"))
    cri = raw.rlike(P.CRI)
    return F.struct(
        F.when(cri, F.regexp_extract(raw, P.CRI, 4)).when(log.isNotNull(), F.regexp_replace(log, "\n+$", "")).otherwise(raw).alias("inner"),
        F.when(cri, F.regexp_extract(raw, P.CRI, 1)).when(log.isNotNull(), F.get_json_object(raw, "$.time")).alias("ts"),
        F.when(cri, F.regexp_extract(raw, P.CRI, 2)).when(log.isNotNull(), F.get_json_object(raw, "$.stream")).alias("stream"),
    )


def time_kind(text: Column) -> Column:
    """Which of the time formats a matched text has, by the signs at fixed places."""
    at = lambda i: F.substring(text, i, 1)
    letter = lambda i: at(i).between("A", "z")
    return (
        F.when(at(5) == "-", F.when(at(11) == "-", F.lit("bgl")).otherwise(F.lit("iso"))).when(at(9) == "-", F.lit("compact"))
        .when(at(3) == "/", F.when(letter(4), F.lit("clf")).otherwise(F.lit("slash2")))
        .when(at(3) == "-", F.lit("md")).when(at(3) == ".", F.lit("dotmd"))
        .when(letter(1), F.when(letter(5), F.lit("ctime")).otherwise(F.lit("syslog")))
        .when(at(7) == " ", F.lit("hdfs")).when(text != "", F.lit("epoch"))
    )


TIME = "|".join(f"(?:{p})" for _, p, _ in P.TIMES)


def time_text(line: Column) -> Column:
    """struct<kind, text> of the leftmost time in the first 64 characters."""
    return once(F.regexp_extract(F.substring(line, 1, 64), TIME, 0), lambda t: F.struct(time_kind(t).alias("kind"), F.when(t != "", t).alias("text")))


def is_dated(line: Column) -> Column:
    return F.substring(line, 1, 64).rlike(TIME)


def time_value(found: Column, year: int = 2000) -> Column:
    """Timestamp without zone, to the second; kinds without a year take ``year``; two-digit years turn at 69."""
    return once(found, lambda f: _time_value(f["kind"], f["text"], year))


def _time_value(kind: Column, text: Column, year: int) -> Column:
    one = lambda t: F.regexp_replace(t, " +", " ")
    century = F.when(F.substring(text, 1, 2).cast("int") >= 69, F.lit("19")).otherwise(F.lit("20"))
    out = F.when(kind == "epoch", F.timestamp_seconds(text.try_cast("long")).cast("timestamp_ntz"))
    for k, _, fmt in P.TIMES[:-1]:
        t = text
        if k == "iso":
            # the commonest: no format to parse by
            out = out.when(kind == k, F.substring(F.translate(text, "T", " "), 1, 19).try_cast("timestamp_ntz"))
            continue
        if k == "bgl":
            t = F.substring(text, 1, 19)
        elif k == "compact":
            t = F.substring(text, 1, 17)
        elif k == "ctime":
            t = F.regexp_replace(one(text), "^[A-Za-z]+ ", "")
        elif k in ("slash2", "hdfs"):
            t, fmt = F.concat(century, text), fmt.replace("yy", "yyyy")
        elif k in ("syslog", "md", "dotmd"):
            t = F.concat(F.lit(f"{year} "), F.regexp_extract(one(text), r"^.*:\d\d:\d\d", 0))
        out = out.when(kind == k, F.try_to_timestamp(t, F.lit(fmt)).cast("timestamp_ntz"))
    return out


def log_time(stamps: list[Column], year: int = 2000) -> Column:
    """The first of the given texts whose time can be read."""
    return F.coalesce(*[time_value(time_text(s), year) for s in stamps])


def is_continuation(line: Column) -> Column:
    return line.rlike(P.CONTINUATION) & ~is_dated(line)


def is_signal(level: Column, probe: Column) -> Column:
    """By level where there is one, else by keyword."""
    return F.when(F.coalesce(level, F.lit("")) != "", level.isin(*P.SIGNAL_LEVELS)).otherwise(F.lower(probe).rlike(P.SIGNAL))


def text_level(line: Column) -> Column:
    return matched(F.substring(line, 1, 120), P.LEVEL, 1)


def last_of_each(pairs: Column) -> Column:
    """map of (key, value) pairs; the last of equal keys wins."""
    later = lambda p, x, i: F.exists(F.slice(p, i + 2, F.greatest(F.size(p), F.lit(1))), lambda y: y["key"] == x["key"])
    return once(pairs, lambda p: F.map_from_entries(F.filter(p, lambda x, i: ~later(p, x, i))))


def logfmt_fields(line: Column) -> Column:
    """map of pairs; quotes go, the last of equal keys wins."""
    whole = F.regexp_extract_all(line, F.lit(P.LOGFMT_PAIR), F.lit(0))

    def pair(x: Column) -> Column:
        at = F.locate("=", x)
        value = F.substring(x, at + 1, F.length(x))
        return F.struct(F.substring(x, F.lit(1), at - 1).alias("key"), F.when(value.startswith('"') & value.endswith('"') & (F.length(value) > 1), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value).alias("value"))

    return last_of_each(F.transform(whole, pair))


def json_fields(line: Column, levels: int = 4) -> Column:
    """Dotted scalar map of an object: arrays go, null is 'None', booleans are capitalised; null if not an object."""
    empty = F.array().cast("array<struct<key:string,value:string>>")

    def entries(v: Column, prefix: Column, depth: int) -> Column:
        def one(x: Column) -> Column:
            name = F.concat(prefix, x["key"])

            def by_kind(kind: Column) -> Column:
                scalar = lambda text: F.array(F.struct(name.alias("key"), text.alias("value")))
                text = F.try_variant_get(x["value"], "$", "string")
                deeper = entries(x["value"], F.concat(name, F.lit(".")), depth - 1) if depth > 1 else empty
                return (
                    F.when(kind.startswith("OBJECT"), deeper).when(kind.startswith("ARRAY"), empty).when(kind == "VOID", scalar(F.lit("None")))
                    .when(kind == "BOOLEAN", scalar(F.initcap(text))).otherwise(scalar(text))
                )

            return once(F.schema_of_variant(x["value"]), by_kind)

        return F.flatten(F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), one))

    return last_of_each(once(F.try_parse_json(line), lambda v: entries(v, F.lit(""), levels)))


def role_key(fields: Column, keys: tuple[str, ...]) -> Column:
    """The field that plays a role: the first of the keys, without regard to case."""
    lower = lambda k: F.filter(F.map_keys(fields), lambda x: F.lower(x) == k)
    return F.coalesce(*[F.get(lower(k), F.lit(0)) for k in keys])


def role(fields: Column, keys: tuple[str, ...]) -> Column:
    return F.try_element_at(fields, role_key(fields, keys))


def normalised(line: Column) -> Column:
    """Lines alike but for ids and numbers: UUIDs where four hyphens are, then no digits."""
    ids = F.when(F.length(line) - F.length(F.translate(line, "-", "")) >= 4, F.regexp_replace(line, P.UUID, "<uuid>")).otherwise(line)
    return F.trim(F.translate(ids, "0123456789", ""))


def mask(line: Column) -> Column:
    for p in P.MASKS:
        line = F.regexp_replace(line, p, "<*>")
    return line


def tokens(line: Column) -> Column:
    return F.split(F.trim(mask(line)), P.SEPARATORS)


def masked_key(toks: Column) -> Column:
    """Tokens with digits become wildcards."""
    return F.array_join(F.transform(toks, lambda t: F.when(t.rlike(r"\d"), F.lit("<*>")).otherwise(t)), " ")


def template(line: Column) -> Column:
    """The masked key of a line's tokens, without making the tokens."""
    return F.regexp_replace(F.regexp_replace(F.trim(mask(line)), P.SEPARATORS, " "), P.DIGIT_TOKEN, "<*>")


def shape(line: Column) -> Column:
    """Skeleton of the first 80 characters; no letter of any script stays."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.substring(line, 1, 80), r"\p{L}+", "A"), r"\d+", "9"), r"\s+", " ")


def placeholders(line: Column) -> Column:
    for p, mark in P.REDACTIONS:
        line = F.regexp_replace(line, P.WIDE + p, mark)
    segments = lambda m: F.regexp_replace(F.regexp_replace(m, "/$", ""), "/[^/]+", "/<seg>")
    return F.regexp_replace(rewritten(line, P.WIDE + P.PATH, segments), P.QUOTED, '"<text>"')


def rewritten(line: Column, pattern: str, one: Callable[[Column], Column], between: Callable[[Column], Column] = lambda x: x) -> Column:
    """The line with ``one`` of each match and ``between`` of the stretches between them."""
    parts = F.arrays_zip(F.split(line, pattern, -1).alias("gap"), F.regexp_extract_all(line, F.lit(pattern), F.lit(0)).alias("found"))
    return F.array_join(F.transform(parts, lambda x: F.concat(between(x["gap"]), F.coalesce(one(x["found"]), F.lit("")))), "")


def epoch_ns_iso(ns: Column) -> Column:
    return F.date_format(F.timestamp_micros(F.floor(ns / 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
