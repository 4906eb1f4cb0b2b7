"""The log evidence engine: parsing, sources, folding, mining, packs, and its SQL counterparts."""

import datetime as dt
import glob
import gzip
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarry.functions import parse, patterns
from quarry.operators import evidence as E
from quarry.operators import mining
from quarry.plans import evidence, forms, pack
from quarry.sources import logs
from quarry.streaming import watch

SF = "/root/testdata/sf0.001"
NAMES = sorted(evidence.ORACLE_SQL | forms.ORACLE_SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {t.split('/')[-1][:-8]} as select * from '{t}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    show = lambda rows: sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)
    want = duck.sql(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall()
    assert show(got.select(*cols).collect()) == show(want)


def test_queries_without_sql(spark):
    for name in set(evidence.QUERIES | forms.QUERIES) - set(NAMES):
        assert (evidence.QUERIES | forms.QUERIES)[name](spark, SF).count() > 0, name
    assert entry.entry(spark).count() > 0


TIMES = {
    "2026-08-04T12:00:00.123Z x": "2026-08-04 12:00:00", "2005-06-03-15.42.50.675872 x": "2005-06-03 15:42:50", "20171223-22:15:29:606 x": "2017-12-23 22:15:29",
    "17/06/09 20:10:40 x": "2017-06-09 20:10:40", "10/Oct/2000:13:55:36 x": "2000-10-10 13:55:36", "Sun Dec  4 04:47:44 2005 x": "2005-12-04 04:47:44",
    "Jun 14 15:16:01 x": "2000-06-14 15:16:01", "Feb 29 15:16:01 x": "2000-02-29 15:16:01", "081109 203615 x": "2008-11-09 20:36:15", "991109 203615 x": "1999-11-09 20:36:15",
    "03-17 16:13:38.811 x": "2000-03-17 16:13:38", "10.30 16:49:06 x": "2000-10-30 16:49:06", "- 1117838570 x": "2005-06-03 22:42:50", "none": None,
}


def test_times(spark):
    rows = spark.createDataFrame([(k,) for k in TIMES], "raw string").select("raw", parse.time_value(parse.time_text(F.col("raw"))).alias("t")).collect()
    assert {r.raw: r.t and str(r.t) for r in rows} == TIMES


def test_json_and_logfmt(spark):
    row = spark.createDataFrame([('{"level":"warn","msg":"m","a":{"b":{"c":1.5}},"l":[1],"n":null,"t":true}', 'ts=1 level=info msg="a b" k=1 k=2')], "j string, f string")
    j, f = row.select(parse.json_fields(F.col("j")), parse.logfmt_fields(F.col("f"))).first()
    assert j == {"level": "warn", "msg": "m", "a.b.c": "1.5", "n": "None", "t": "True"}
    assert f == {"ts": "1", "level": "info", "msg": "a b", "k": "2"}


def test_envelopes(spark):
    rows = spark.createDataFrame([("2026-01-01T00:00:00Z stdout F hello",), ('{"log":"hi\\n","stream":"stderr","time":"t"}',), ("plain",)], "raw string")
    assert [r[0].inner for r in rows.select(parse.envelope(F.col("raw"))).collect()] == ["hello", "hi", "plain"]


def test_files(spark, tmp_path):
    text = "".join(f"2026-01-01 00:00:{i % 60:02d} INFO é line {i}\n" for i in range(500))
    (tmp_path / "a.log").write_text(text)
    with gzip.open(tmp_path / "b.log.gz", "wt") as f:
        f.write(text)
    (tmp_path / "c.log").write_bytes(bytes(range(256)) * 10)
    (tmp_path / "d.log").write_text("")
    (tmp_path / "e.log").write_bytes("x\ny\n".encode("utf-16"))
    rows = logs.read_lines(spark, str(tmp_path / "a.log")).orderBy("line_no").collect()
    assert [r.raw + "\n" for r in rows] == text.splitlines(True)
    assert rows[7].byte_off == len("".join(text.splitlines(True)[:7]).encode()) and rows[0].total_bytes == len(text.encode())
    assert logs.read_lines(spark, str(tmp_path / "b.log.gz")).count() == 500
    assert [r.raw for r in logs.read_lines(spark, str(tmp_path / "e.log")).orderBy("line_no").collect()] == ["x", "y"]
    for bad in ("c.log", "d.log"):
        with pytest.raises(logs.UnreadableLog):
            logs.read_lines(spark, str(tmp_path / bad))
    assert logs.find_logs(spark, str(tmp_path), 100).count() == 3 - 1
    a = logs.read_lines(spark, str(tmp_path / "a.log"))
    assert logs.read_sources([a, a.withColumn("source", F.lit("z"))]).count() == 1000


def test_odd_files(spark, tmp_path):
    """What is no log raises; the rest is read whole."""
    put = lambda name, data: (tmp_path / name).write_bytes(data)
    line = "2026-01-01 00:00:{:02d} INFO line {}"
    put("fake.gz", b"not gzip at all"), put("broken.gz", b"\x1f\x8b\x08junkjunkjunk"), put("nul.log", b"a\0b\n"), put("noise.log", bytes(range(1, 32)) * 30), put("empty.log", b"")
    for bad in ("fake.gz", "broken.gz", "nul.log", "noise.log", "empty.log", "missing.log", "."):
        with pytest.raises(logs.UnreadableLog):
            logs.read_lines(spark, str(tmp_path / bad))
    put("one.log", b"only line"), put("bom.log", "\ufeffhello\nyou\n".encode()), put("crlf.log", b"a\r\nb\r\n"), put("long.log", b"x" * 200_000 + b"\nend\n")
    put("be.log", b"\xfe\xff" + "x \u00e9\ny\n".encode("utf-16-be"))
    raw = lambda name: [r.raw for r in logs.read_lines(spark, str(tmp_path / name)).orderBy("line_no").collect()]
    assert raw("one.log") == ["only line"] and raw("bom.log") == ["hello", "you"] and raw("crlf.log") == ["a", "b"] and raw("be.log") == ["x \u00e9", "y"]
    assert [len(x) for x in raw("long.log")] == [65_536] * 3 + [200_000 - 3 * 65_536, 3]
    with open(tmp_path / "sparse.log", "wb") as f:
        f.write(b"2026-01-01 INFO x\n" * 500)
        f.truncate(3 << 30)
    assert logs.probe(spark, str(tmp_path / "sparse.log"))[1] == 3 << 30
    for pod in ("p1", "p2"):
        (tmp_path / pod).mkdir()
        (tmp_path / pod / "0.log").write_text("\n".join(line.format(i, i) for i in range(3)) + "\n")
    both = logs.read_lines(spark, str(tmp_path / "p*" / "0.log")).collect()
    assert sorted(r.line_no for r in both) == [1, 1, 2, 2, 3, 3] and len({r.source for r in both}) == 2 and {r.file for r in both} == {"0.log"}
    put("lines.log", b"0123456789\n" * 300_000)
    assert logs.line_estimate(spark, str(tmp_path / "lines.log")) == pytest.approx(300_000, rel=0.01)
    with open(tmp_path / "lines.log", "rb") as f:
        assert logs.read_stdin(spark, f, str(tmp_path)).count() == 300_000


def test_merge_of_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("2026-01-01 00:00:01 a1\n  at a\n2026-01-01 00:00:05 a2\n")
    (tmp_path / "b.log").write_text("2026-01-01 00:00:03 b1\n2026-01-01 00:00:05 b2\n")
    (tmp_path / "c.log").write_text("no\ntimes\nat\nall\n2026-01-01 00:00:00 here\n")
    read = lambda *names: [r.raw for r in logs.read_sources([logs.read_lines(spark, str(tmp_path / n)) for n in names]).collect()]
    assert read("b.log", "a.log") == ["2026-01-01 00:00:01 a1 src=a.log", "  at a src=a.log", "2026-01-01 00:00:03 b1 src=b.log", "2026-01-01 00:00:05 b2 src=b.log", "2026-01-01 00:00:05 a2 src=a.log"]
    assert read("c.log", "b.log")[0] == "no src=c.log" and len(read("c.log", "b.log")) == 7  # too few times: one after the other
    p = pack.analyze(spark, [str(tmp_path / "a.log"), str(tmp_path / "b.log")])
    assert p["total_lines"] == 5 and p["tail"][-1].endswith("src=b.log") and p["format"] == "text"


def test_fields_that_play_no_role_stay(spark):
    rows = [(1, '{"time":"bad","@timestamp":"2026-01-01T00:00:01Z","text":"t","msg":"m","Level":"warn","lvl":"x","a.b":1,"a":{"b":2}}', "s")] * 2
    got = E.events(spark.createDataFrame([(r[0], r[1], "s", 1, 1, 1) for r in rows], "line_no long, raw string, source string, head_no int, byte_off int, total_bytes int"), "json").first()
    assert got.fields == {"@timestamp": "2026-01-01T00:00:01Z", "text": "t", "lvl": "x", "a.b": got.fields["a.b"]} and got.level == "WARN" and got.msg == "m" and str(got.ts) == "2026-01-01 00:00:01"
    line = '{"msg":"x latency=12ms","shard":"s1","count=7":"y"}'
    ev = E.probed(E.events(spark.createDataFrame([(1, line, "s", 1, 1, 1)], "line_no long, raw string, source string, head_no int, byte_off int, total_bytes int"), "json"))
    assert {(r.key, r.num) for r in E.series(ev).collect()} == {("latency", 12.0), ("count", 7.0)} or {r.key for r in E.series(ev).collect()} >= {"latency"}


def test_bounds_as_text(spark, tmp_path):
    day = dt.datetime(2024, 2, 29, 10)
    for text, want in (("2026-08-04T02:00", "2026-08-04 02:00:00"), ("2026-08-04", "2026-08-04 00:00:00"), ("10/Oct/2000:13:55:36", "2000-10-10 13:55:36"), ("[02:30]", "2024-02-29 02:30:00"), ("02:30:05", "2024-02-29 02:30:05"), ("Mar 01 02:30:05", "2024-03-01 02:30:05")):
        assert str(pack.when(text, day)) == want
    with pytest.raises(ValueError):
        pack.when("soon")
    (tmp_path / "x.log").write_text("".join(f"2024-02-29 {h:02d}:00:00 INFO hour {h}\n" for h in range(24)))
    lines = logs.read_lines(spark, str(tmp_path / "x.log"))
    assert sum(x["cnt"] for x in pack.pack(lines, since="05:00", until="07:00")["rare"]) == 3
    assert pack.first_year(lines) == 2024


def test_agent_functions(spark, tmp_path):
    (tmp_path / "x.log").write_text("".join(f"2026-01-01 00:{i // 60:02d}:{i % 60:02d} INFO api op=get latency={10 + i}ms\n" for i in range(600)))
    path = str(tmp_path / "x.log")
    about = pack.inspect_log_file(spark, path)
    assert about["lines"] == 600 and about["encoding"] == "UTF-8" and not about["gzip"]
    d = pack.log_parse_diagnostics(spark, path)
    assert d["format"] == "text" and d["ts_pct"] == 100 and d["levels"] == [("INFO", 600)] and d["compression"] > 100 and d["warnings"] == ["no rare events: state changes may be missing"]
    text = pack.read_log_evidence(spark, path)
    assert "TRENDS\nlatency GREW" in text and text.rstrip().endswith("latency=609ms")
    wide = {"total_lines": 1, "signal_lines": 1, "templates": 1, "format": "text", "patterns": [{"cnt": 1, "is_new": True, "template": "x" * 4000}] * 18, "rare": [], "trends": [], "dims": [], "context": ["c" * 9000], "tail": ["t" * 9000]}
    cut = pack.to_prompt(wide)
    assert len(cut) <= pack.MOST and all(h in cut for h in ("PATTERNS", "RARE", "TRENDS", "DIMENSIONS", "CONTEXT", "TAIL"))
    pack.write_metrics(spark, [d], str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().lines == 600


def test_fold_across_runs(spark):
    raw = ["x"] + ["  at f(y)"] * 9 + ["z", "  w"]
    rows = spark.createDataFrame([("s", i + 1, r) for i, r in enumerate(raw)], "source string, line_no long, raw string")
    got = [r.head_no for r in E.fold(rows, run=4).orderBy("line_no").collect()]
    assert got == [1] * 10 + [11, 11]


def test_miner():
    lines = [f"INFO user u{i} logged in from 10.0.0.{i}" for i in range(20)] + ["WARN disk full on sda"] * 3
    m = mining.Miner.frozen(mining.Miner().train(lines).state())
    assert {m.match(x) for x in lines} == {"INFO user <*> logged in from <*>", "WARN disk full on sda"}
    assert m.match("nothing like 7 it") == "nothing like <*> it"
    two = [f"job {('ok', 'bad')[i % 2]} done in time" for i in range(600)]
    assert len({mining.Miner.frozen(mining.Miner().train(two).state()).match(x) for x in two}) == 2


def test_pack(spark, tmp_path):
    lines = [f"2026-01-01 00:{i // 60:02d}:{i % 60:02d} INFO api op=get latency={10 + i}ms shard={i % 4}" for i in range(600)]
    lines[400] = "2026-01-01 00:06:40 INFO deploy applied to web"
    lines[450:] = [x.replace("INFO", "ERROR").replace("api", "api failed") for x in lines[450:]]
    (tmp_path / "x.log").write_text("\n".join(lines) + "\n")
    p = pack.analyze(spark, str(tmp_path / "x.log"))
    assert p["total_lines"] == 600 and p["signal_lines"] == 150 and p["onset"]["first_frac"] > 0.7
    assert any(t["key"] == "latency" and t["direction"] == "GREW" for t in p["trends"])
    assert "deploy" in p["rare"][0]["template"] and p["rare"][0]["relation"] == "before"
    assert any("failed" in x for x in p["context"]) and sum(p["density"]) == 150 and "TRENDS" in pack.to_prompt(p)
    short = pack.analyze(spark, str(tmp_path / "x.log"), last="1m")
    assert short["signal_lines"] == 61


def test_redact(spark):
    rows = [("s", i, f"known word here user bob{i}x at http://h/p a@b.co 10.1.2.3 id={i}") for i in range(30)]
    got = E.redact(spark.createDataFrame(rows, "source string, line_no long, raw string")).orderBy("line_no").first().redacted
    assert got == "known word here user <w> at <url> <email> <ip> id=9"


def redact_line(line, vocab):
    """The rules in their order; placeholders stay whole."""
    head = m.group() if (m := re.match(r"\[?[\d\-/:T. +]{8,32}\]?", line)) else ""
    line = line[len(head):]
    for pattern, mark in (
        (r"(?i)\b[a-z]+://[^\s\"']+", "<url>"), (r"[\w.+-]+@[\w-]+\.[\w.-]+", "<email>"), (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>"),
        (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<ip>"), (r"(?i)\b(?:[0-9a-f]{1,4}:){2,}[0-9a-f]{1,4}\b", "<ip6>"), (r"(?i)\b[0-9a-f]{16,}\b", "<hex>"), (r"\b[A-Za-z0-9+/]{24,}={0,2}\b", "<b64>"),
        (r"(/[\w.\-@+]+){2,}/?", lambda m: "/" + "/".join("<seg>" for _ in m.group(0).strip("/").split("/"))), (r"\"([^\"]{3,})\"|'([^']{3,})'", '"<text>"'),
    ):
        line = re.sub(pattern, mark, line)
    out = []
    for gap, mark, word in re.findall(r"(.*?)(?:(<(?:url|email|uuid|ip6?|hex|b64|seg|text)>)|([A-Za-z][A-Za-z0-9_.\-]{2,})|$)", line):
        out += [re.sub(r"\d", "9", gap), mark, re.sub(r"\d", "9", word) if word.lower() in vocab else "<w>" if word else ""]
    return head + "".join(out)


@pytest.mark.parametrize("most", [20_000, 3])
def test_redact_line_by_line(spark, monkeypatch, most):
    odd = [
        "2026-08-04 12:00:01.5 INFO known 42alice _alice --alice .alice alice9 7", "[2026-08-04T12:00:01] known", "known /home/alice/known.log and /var/known/ or /one, a//b/c",
        'known said "known known" and \'it was\' "ab" \'\'', "known url email b64 ip6 text <url> <b64> <secret>", "known fe80:0:0:1:a:b at 123e4567-e89b-12d3-a456-426614174000 0123456789abcdef01",
        "known QWxhZGRpbjpvcGVuIHNlc2FtZQQQ== http://h/p?q=known jos\u00e9@example.org \u0663\u0664 known5 KNOWN", "abc xabcx known", "", "   ", "12345678", "at 'known", "known/known/known x=/a/b/c/",
    ]
    raw = odd + ["known info and alright xabcx said or at"] * 25
    counts = Counter(x.lower() for r in raw for x in re.findall(r"[A-Za-z][A-Za-z0-9_.\-]{2,}", r))
    vocab = {x for x, n in counts.items() if n >= 20} | set(patterns.KEEP_WORDS)
    rows = [("s", i, r) for i, r in enumerate(raw)]
    monkeypatch.setattr(E, "MOST_WORDS", most)
    got = E.redact(spark.createDataFrame(rows, "source string, line_no long, raw string").repartition(3)).orderBy("line_no").collect()
    assert [r.redacted for r in got] == [redact_line(r, vocab) for r in raw]
    assert got[0].redacted == "2026-08-04 12:00:01.5 INFO known 99<w> _<w> --<w> .<w> <w> 9"


def test_health_sees_every_line(spark):
    """A file whose format breaks after the 20,000 lines that the shapes are taken of."""
    good, bad = "concat('2026-01-01 00:00:01 INFO x ', id)", "if(id % 2 = 0, 'ERROR lost its time', 'no time')"
    rows = spark.range(1, 50_001).selectExpr("'s' as source", "id as line_no", f"case when id % 100 = 0 then ' ' when id <= 25000 then {good} else {bad} end as raw")
    got = E.health(rows).first()
    n, dated, errors = 49_500, 24_750, 12_250
    assert (got.lines, got.ts_pct, got.level_pct) == (n, 100 * dated / n, 100 * (dated + errors) / n)
    assert [tuple(x) for x in got.levels] == [("INFO", dated), ("ERROR", errors)]
    full = E.health_report(rows).first()
    assert full.format == "text" and full.lines == n and [tuple(x) for x in full.shapes] == [("9-9-9 9:9:9 A A 9", 20_000)]
    none = E.health(rows.limit(0)).first()
    assert none.lines == 0 and none.levels == []


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("2026-01-01 00:00:01 ERROR x\n2026-01-01 00:00:02 INFO y\n  at z\n")
    q = watch.signal_windows(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("watched").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert spark.table("watched").agg(F.sum("lines"), F.sum("signals")).first()[:] == (2, 1)


def test_durations():
    assert E.seconds("1.5h") == 5400 and E.seconds("7D") == dt.timedelta(days=7).total_seconds()
    with pytest.raises(ValueError):
        E.seconds("soon")
