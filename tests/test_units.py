import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions import commands as C
from millrace.functions import lines as L
from millrace.operators import ledger as G
from millrace.plans.compact import compact
from millrace.plans.config import Config
from millrace.sources import tables as T
from millrace.streaming.stream import stream_savings


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("x")).first().x


def test_lines(spark):
    cases = {
        "npm ERR! x": True, "TypeError: y": True, "   at f (a.js:1)": True, "get https://r/error-ex": False, "éerror": True, "errors": True,
        "terror": True, "errored": False, "main.go:3: x": True, "all fine": False, None: False,
    }
    got = {r.t: r.x for r in spark.createDataFrame([(k,) for k in cases], "t string").select("t", L.is_failure(F.col("t")).alias("x")).collect()}
    assert got == cases
    assert one(spark, "a 2024-01-02T03:04:05Z 0xff deadbeef1 'q' 12.5  ", L.similarity_key) == "a <ts> <hex> <hash> '<s>' <n>"
    assert one(spark, "x" * 10 + "é" * 50, lambda c: L.short_command(c, 20)) == "x" * 10 + "é" * 3 + "…"
    assert one(spark, "/usr/bin/my cmd!!x", L.archive_label) == "my-cmd-x"
    assert one(spark, "a.py:3:4 and b/c.go:7", L.file_line_refs) == ["a.py:3:4", "b/c.go:7"]


@pytest.mark.parametrize(("command", "key"), [
    ("npm run build --x", "npm run build"), ("npm install a", "npm install"), ("git", "git"), ("", "(empty)"), ("bash -c 'npm ci && x'", "npm ci"),
    ("/usr/bin/git status -s", "/usr/bin/git status"), ("make -j8 all", "make"), ("docker exec c ls", "docker exec c"),
])
def test_command_key(spark, command, key):
    assert one(spark, command, C.command_key) == key


def test_wrap_and_rewrite(spark):
    calls = spark.createDataFrame([
        (1, '{"tool_name":"Bash","tool_input":{"command":"make it\'s","timeout":5}}'), (2, '{"tool_name":"Read","tool_input":{"command":"make"}}'),
        (3, "not json"), (4, '{"tool_name":"Bash","tool_input":{"command":"git log"}}'), (5, '{"tool_name":"Bash","tool_input":{}}'),
    ], "call_id long, payload string")
    rows = C.rewrite_tool_call(calls, runner="run").collect()
    assert [r.call_id for r in rows] == [1]
    import json

    assert json.loads(rows[0].reply)["hookSpecificOutput"]["updatedInput"] == {"command": "run bash -c 'make it'\\''s'", "timeout": 5}


def test_since():
    now = datetime(2024, 5, 1)
    assert G.parse_since("", now) is None and G.parse_since("7d", now) == now - timedelta(days=7)
    assert G.parse_since("1h30m", now) == now - timedelta(minutes=90) and G.parse_since("2w", now) == now - timedelta(days=14)
    for bad in ("x", "-1d", "5", "d"):
        with pytest.raises(ValueError):
            G.parse_since(bad, now)


def test_fast_predicates_equal_the_patterns(spark):
    import random

    from millrace.functions import patterns as P

    rng = random.Random(3)
    pieces = ["error", "ERRORS", "Err", "err!", "fail", "failing", "FAILED", "failures", "panic", "panicked", "E123", "e12", "MSB1", "CS1234", "cs12345", "NETSDK7", "assert", "fatal", "traceback", "unhandled",
              "segfault", "segmentation fault", "exception", "s", "_", " ", " ", ".", "é", "x", "1", "%", "50%", "ETA:", "/", "3 MB", "o", "#", "=", "\t", "\u00a0", "-", "[", "]", ">"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 7))) for _ in range(20_000)]
    t = F.col("t")
    trimmed = L._trim(t)
    slow = F.coalesce((trimmed != "") & (trimmed.rlike(P.PROGRESS_BAR_JAVA) | trimmed.rlike(P.java(P.PROGRESS_FIGURE))), F.lit(False))
    df = spark.createDataFrame([(x,) for x in texts], "t string").repartition(4)
    wrong = df.where((t.rlike(P.FAILURE_JAVA) != t.rlike(P.java(P.FAILURE))) | (L.is_progress(t) != slow))
    assert wrong.count() == 0
    n = df.agg(F.count_if(t.rlike(P.FAILURE_JAVA)).alias("a"), F.count_if(L.is_progress(t)).alias("b")).first()
    assert 1000 < n.a < 19_000 and 200 < n.b < 19_000


def test_ledger_file(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"time":"2024-01-02T00:00:00Z","command":"npm ci","filters":["a"],"raw_bytes":10,"out_bytes":4}\n\nbad{\n{"time":"2023-01-01T00:00:00Z","command":"x","raw_bytes":1,"out_bytes":5}\n')
    df = T.read_ledger(spark, str(tmp_path / "l.json"))
    assert df.count() == 2 and T.read_ledger(spark, str(tmp_path / "l.json"), datetime(2023, 6, 1)).count() == 1
    row = G.ledger_totals(df).first()
    assert (row.runs, row.filtered_runs, row.saved) == (2, 1, 2)
    assert [r.command_key for r in G.top_commands(df, 1).collect()] == ["npm ci"]
    assert G.report(df.where("false")).first().line == "No runs recorded." == G.report(df.where("false"), 0).first().line
    assert sorted(map(tuple, G.report(df, 0).collect())) == sorted(map(tuple, G.report(df, 10).collect())) and G.report(df, 0).count() == 2


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64])
def test_chunks_make_the_same_lines(spark, size):
    text = "é one\n\ntwo\r\nlast é"
    raw = text.encode()
    rows = [(1, i, raw[i * size : (i + 1) * size]) for i in range(-(-len(raw) // size))]
    got = T.reassemble_lines(spark.createDataFrame(rows, "run_id long, seq long, data binary")).orderBy("line_no").collect()
    assert [r.text for r in got] == text.split("\n")


#: Guard and dedup only: a small plan, which is enough for sinks and streams.
SMALL = Config(off=frozenset({"ansi", "node-install", "test-runner", "docker-build", "dotnet", "truncate"}))


def _run(n):
    return [f"info: [x] step {i} took {i} ms in the build" if i % 9 else f"Error: {i}" for i in range(n)]


def test_sinks(spark, tmp_path):
    texts = _run(200)
    lines = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "run_id long, line_no long, text string")
    runs = spark.createDataFrame([(1, "make", ["make"])], "run_id long, command string, argv array<string>")
    kept, gone, stats = (x.cache() for x in compact(lines, runs, SMALL))
    want = [r.text for r in kept.orderBy("out_no").collect()]
    assert stats.first().bytes_out < stats.first().bytes_in and gone.count() > 0
    T.write_compacted(kept, str(tmp_path / "out"))
    T.write_raw_archive(lines, stats, str(tmp_path / "raw"))
    T.append_ledger(stats, runs, str(tmp_path / "ledger"), datetime(2024, 1, 1), archive="raw")
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 200
    entry = spark.read.parquet(str(tmp_path / "ledger")).first()
    assert (entry.command, entry.raw_log) == ("make", "raw#run_id=1")
    written = spark.read.parquet(str(tmp_path / "out")).orderBy("out_no")
    assert [r.text for r in written.collect()] == want
    assert T.read_ledger(spark, str(tmp_path / "no such ledger")).count() == 0


def test_prune(spark, tmp_path):
    logs, now = tmp_path / "logs", datetime.now()
    (logs / "deep er").mkdir(parents=True)
    for n, (name, age) in enumerate({"a.log": 3, "b.log": 0, "c.txt": 9, "deep er/d é.log": 9}.items()):
        (logs / name).write_text("x" * (n + 1))
        os.utime(logs / name, ((now - timedelta(days=age)).timestamp(),) * 2)
    assert T.prune_archive(spark, str(logs), 0, now).count() == 0
    report = {r.path.rsplit("/", 1)[1].replace("%20", " "): (r.length, r.deleted, r.error) for r in T.prune_archive(spark, str(logs), 2, now).collect()}
    assert report == {"a.log": (1, True, None), "d é.log": (4, True, None)}
    assert sorted(p.name for p in logs.rglob("*") if p.is_file() and not p.name.startswith(".")) == ["b.log", "c.txt"]
    assert T.prune_archive(spark, str(logs), 2, now).count() == 0


def test_prune_days(spark, tmp_path):
    lines = spark.createDataFrame([(1, 1, "a")], "run_id long, line_no long, text string")
    stats = spark.createDataFrame([(1, True, ["dedup"])], "run_id long, filtered boolean, filters array<string>")
    for day in (1, 5, 9):
        T.write_raw_archive(lines, stats, str(tmp_path / "raw"), date(2024, 3, day))
    assert T.prune_days(spark, str(tmp_path / "raw"), 0, date(2024, 3, 10)) == [] == T.prune_days(spark, str(tmp_path / "none"), 3, date(2024, 3, 10))
    assert T.prune_days(spark, str(tmp_path / "raw"), 5, date(2024, 3, 10)) == ["day=2024-03-01"]
    assert T.prune_days(spark, str(tmp_path / "raw"), 5, date(2024, 3, 10)) == [] and spark.read.parquet(str(tmp_path / "raw")).count() == 2


def test_a_retried_batch_adds_nothing_twice(spark, tmp_path):
    stats = spark.createDataFrame([(i, True, ["dedup"], 100, 40) for i in (1, 2)], "run_id long, filtered boolean, filters array<string>, raw_bytes long, bytes_out long")
    runs = spark.createDataFrame([(1, "make"), (2, "npm ci")], "run_id long, command string")
    ledger = str(tmp_path / "ledger")
    when = datetime(2024, 1, 1)
    T.append_ledger(stats.where("run_id = 1"), runs, ledger, datetime(2024, 1, 2), batch="7")  # an attempt that died half way, on another day
    for _ in range(2):
        T.append_ledger(stats, runs, ledger, when, batch="7")
    T.append_ledger(stats.where("run_id = 2"), runs, ledger, when, batch="8")
    assert sorted(r.command for r in spark.read.parquet(ledger).collect()) == ["make", "npm ci", "npm ci"]
    T.append_ledger(stats, runs, ledger + "_json", when, "json", batch="1")
    assert T.read_ledger(spark, ledger + "_json/*/*").count() == 2


def test_huge_files_are_read_in_ranges(spark, tmp_path):
    texts = {"a": [f"line {i} {'x' * (i % 50)} é" for i in range(3000)], "b": ["", "one\r", "", "last"], "c": []}
    for name, rows in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "input.txt").write_bytes("\n".join(rows).encode() + (b"\n" if name == "a" else b""))
        (tmp_path / name / "cmd").write_text("npm  test\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        lines, runs = T.read_runs(spark, str(tmp_path))
        names = {r.run_id: r.name for r in runs.collect()}
        assert sorted(names.values()) == ["a", "b", "c"] and {tuple(r.argv) for r in runs.collect()} == {("npm", "test")}
        got = {}
        for r in lines.orderBy("run_id", "line_no").collect():
            got.setdefault(names[r.run_id], []).append((r.line_no, r.text))
        assert lines.rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {n: [(i + 1, t.rstrip("\r")) for i, t in enumerate(rows)] for n, rows in texts.items() if rows}


def test_stream_savings(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 01:00:00' as time, 10L as raw_bytes, 4L as out_bytes").write.parquet(str(tmp_path / "l"))
    source = spark.readStream.schema("time timestamp, raw_bytes long, out_bytes long").parquet(str(tmp_path / "l"))
    q = stream_savings(source).writeStream.format("memory").queryName("savings_t").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("savings_t").first().saved == 6


#: Commands and whether their output is to be compacted, and argument lists and their kinds.
WRAPPED = """jest --coverage|vitest run|npx jest|pytest -q tests/|go test ./...|cargo test|npm install|npm ci|npm test|npm run build|docker build -t app .|dotnet build|dotnet test
make -j8|git commit -m wip|git push|npm ci && npm run build|./scripts/deploy.sh|CI=1 npm run build"""
LEFT_ALONE = """millrace run -- ls|npm run dev|npm start|npm run test:watch|pnpm run serve|yarn build --watch|dotnet watch run|docker run -it ubuntu bash|docker run ubuntu|tail -f app.log
docker logs -f app|NODE_ENV=production npm run dev|npm run build > out.log 2>&1|npm run build &> out.log|npm ls --all|npm outdated|npm why lodash|gh pr list|cat package.json
jq '.scripts' package.json|head -50 big.log|sed -n '10,20p' file.txt|git config --list|git log|git log --oneline -50|git show HEAD|git diff HEAD~3|git status|git blame README.md
git shortlog -sn|git reflog|git rev-list --count HEAD|git ls-files|docker images|docker ps -a|kubectl get pods|pip freeze|pip list|cargo tree|go env|go list ./...|terraform output
brew info jq|npm run build --help|docker build --help|make --version"""
PIPED_OR_EMPTY = ("npm run build | tail -40", "npm ls --all | wc -l", "")
KINDS = {
    "node-install": [["npm", "install"], ["npm", "ci"], ["npm", "i", "--save-dev", "jest"], ["pnpm", "add", "lodash"], ["yarn"], ["bash", "-c", "npm ci && npm run build"], ["npm.cmd", "install"]],
    "node-script": [["npm", "run", "build"], ["npm", "test"], ["pnpm", "run", "lint"], ["C:\\Program Files\\nodejs\\npm.cmd", "run", "build"]],
    "docker-build": [["docker", "build", "-t", "app", "."], ["bash", "-c", "docker build ."]],
    "dotnet": [["dotnet", "build"], ["dotnet", "test"], ["bash", "-c", "cd app && dotnet test"]], "generic": [["make", "-j8"]],
}


def test_labelled_decisions(spark):
    split = lambda text: [c for line in text.splitlines() for c in line.split("|")]
    want = {c: True for c in split(WRAPPED)} | {c: False for c in [*split(LEFT_ALONE), *PIPED_OR_EMPTY]}
    df = spark.createDataFrame([(c,) for c in want], "command string")
    got = {r.command: r.wrap for r in df.select("command", C.wrap_decision(F.col("command"))["wrap"].alias("wrap")).collect()}
    assert {c: w for c, w in got.items() if w != want[c]} == {} and len(got) == 68


def test_labelled_kinds(spark):
    rows = [(kind, argv) for kind, own in KINDS.items() for argv in own]
    df = spark.createDataFrame(rows, "kind string, argv array<string>")
    assert [tuple(r) for r in df.select("kind", "argv", C.classify_kind(F.col("argv")).alias("got")).where("kind <> got").collect()] == [] and len(rows) == 17
