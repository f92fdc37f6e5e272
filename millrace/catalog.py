"""Queries over the driver's tables, one or more for every operator, and the same in SQL where it can say them.

Line, command, ledger and tool-call tables are derived from ``events``, ``documents`` and ``conversations``
by the same rules on both sides; they grow with those tables.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import commands as C
from .functions import lines as L
from .functions import patterns as P
from .operators import audit as A
from .operators import ledger as G
from .operators import stages as S
from .plans import compact as K
from .plans.config import Config
from .sources import tables as T
from .streaming.stream import stream_savings

FLAGSHIP = "compact_stats"
CFG = Config(before=2, after=2, head=10, tail=15)

#: The text of an event's line, in SQL that both engines read.
LINE = """CASE event_id % 31
 WHEN 0 THEN 'Error: event ' || cast(event_id as string) || ' failed'
 WHEN 1 THEN '    at run (app.js:' || cast(event_id % 90 as string) || ':5)'
 WHEN 2 THEN '  1) suite case' WHEN 3 THEN '     AssertionError: expected 5' WHEN 4 THEN '      + expected - actual'
 WHEN 5 THEN '      -5' WHEN 6 THEN ''
 WHEN 7 THEN chr(27) || '[32mok' || chr(27) || '[0m done'
 WHEN 8 THEN '10%' || chr(13) || '50%' || chr(13) || cast(event_id % 101 as string) || '%' || chr(13)
 WHEN 9 THEN 'Downloading ' || cast(event_id % 20 as string) || '.5 MB / 20 MB' WHEN 10 THEN '[#####     ]'
 WHEN 11 THEN 'info: [db] SELECT {"ms":' || cast(event_id % 40 as string) || '}'
 WHEN 12 THEN 'info: [db] SELECT {"ms":' || cast(event_id % 50 as string) || '}'
 WHEN 13 THEN 'get https://registry/error-ex/' || cast(event_id % 7 as string)
 WHEN 14 THEN 'npm warn deprecated left-pad@1.0.' || cast(event_id % 5 as string)
 WHEN 15 THEN 'npm http fetch GET 200' WHEN 16 THEN 'added 5 packages'
 WHEN 17 THEN '  App' || cast(event_id % 3 as string) || ' -> /src/bin/App.dll'
 WHEN 18 THEN '  Restored /src/a.csproj (in 1.2 sec).' WHEN 19 THEN 'src/a.cs: warning CS0168: unused'
 WHEN 20 THEN '  ✓ works' WHEN 21 THEN 'ok ' || cast(event_id as string) WHEN 22 THEN '  duration_ms: 3'
 WHEN 23 THEN '#' || cast(event_id % 2 as string) || ' [2/6] RUN npm ci' WHEN 24 THEN '#' || cast(event_id % 2 as string) || ' sha256:abc'
 WHEN 25 THEN '#' || cast(event_id % 2 as string) || ' log line'
 WHEN 26 THEN '#' || cast(event_id % 2 as string) || CASE WHEN event_id % 3 = 0 THEN ' ERROR: no' ELSE ' DONE 1.2s' END
 WHEN 27 THEN 'main.go:12:3: undefined'
 WHEN 28 THEN 'id 550e8400-e29b-41d4-a716-446655440000 at 2024-01-02T03:04:05Z hash deadbeef01 it''s ''x'' 0xff'
 WHEN 29 THEN 'plain line ' || cast(event_id % 4 as string) ELSE '   ' END"""
EVT = f"SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no, {LINE} AS text FROM events"
#: Lines of documents.
DOC = "SELECT doc_id AS run_id, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)"

COMMANDS = (
    "npm ci", "npm install left-pad", "npm test", "npm run build", "yarn", "yarn test", "pnpm exec jest --ci", "npx jest", "npx --yes eslint src/",
    "docker build -t app .", "docker run -it app", "docker run --rm app", "docker logs web", "podman build .", "dotnet build", "dotnet test -v q",
    "git log --oneline", "git push origin main", "git", "cargo test -v", "cargo build --release", "make -j8", "ls -la | head", "cat a.txt", "tail -f app.log",
    "sed -n 1,5p a", "sed s/a/b/ a", "go test ./...", "FOO=1 BAR=2 npm test", "/usr/bin/npm.cmd run lint", r"C:\\tools\\Docker.exe build .", "bash -c npm test",
    "sh -c pytest && echo done", "npm run dev", "npm run test:watch", "python3 train.py > out.log 2>&1", "pytest -q &> log", "echo 'a;b' ; make", "kubectl get pods",
    "yarn jest", "yarn dlx create-app", "gh pr list", "  ", "jq . a.json", "millrace run -- make", "python3 a.py --mode=" + "x" * 90,
)
#: What the commands are, read off the rules by hand: kind, whether the words are a query, whether argv is, whether
#: it is long-running, and the reason of the decision.
KIND_OF = (
    "node-install node-install node-script node-script node-install node-script node-script generic generic docker-build docker-build docker-build "
    "docker-build docker-build dotnet query query generic query query generic generic generic query query query generic generic node-script "
    "node-script docker-build node-script generic node-script node-script generic generic generic query node-script node-script query generic query "
    "generic generic"
).split()
QUERIES_BY_WORDS = (15, 16, 18, 19, 23, 25, 38, 41, 43)
LONG = (10, 12, 24, 33, 34)
REASON_OF = {
    "a query: its output is the answer": (15, 16, 18, 19, 23, 25, 38, 41, 43), "long-running or interactive": (10, 12, 24, 33, 34),
    "the pipeline selects its output": (22,), "output goes to a file": (35, 36), "empty command": (42,), "already handled": (44,),
}
PEELED = {6: "jest --ci", 7: "jest", 8: "--yes eslint src/", 28: "npm test", 39: "jest", 40: "create-app", 42: ""}
SEGMENTS = {
    22: ("ls -la", "head"), 32: ("sh -c pytest", "echo done"), 35: ("python3 train.py > out.log 2>", "1"), 36: ("pytest -q", "> log"),
    37: ("echo 'a;b'", "make"), 42: (),
}
_COMMAND = "list_extract([" + ", ".join("'" + c.replace("'", "''") + "'" for c in COMMANDS) + f"], cast(event_id % {len(COMMANDS)} + 1 as int))"
CMD = f"SELECT event_id AS call_id, {_COMMAND} AS command FROM events"
LEDGER = (
    f"SELECT ts AS time, {_COMMAND} AS command, cast(round(abs(value) * 100) as bigint) AS raw_bytes, "
    "cast(round(abs(value) * 100) as bigint) * (event_id % 7) // 5 AS out_bytes, event_id % 3 > 0 AS filtered FROM events"
)


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def event_lines(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _read(spark, d, "events").select(F.col("user_id").alias("run_id"), n.cast("long").alias("line_no"), F.expr(LINE).alias("text"))


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "documents").select(F.col("doc_id").alias("run_id"), F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return rows.select("run_id", (F.col("n") + 1).cast("long").alias("line_no"), "text")


def _command() -> F.Column:
    return F.element_at(F.array(*[F.lit(c) for c in COMMANDS]), (F.col("event_id") % len(COMMANDS) + 1).cast("int"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "events").select(F.col("event_id").alias("call_id"), _command().alias("command"))


def event_runs(spark: SparkSession, d: str) -> DataFrame:
    """One run per user, with a command picked by the user's number."""
    pick = F.element_at(F.array(*[F.lit(c) for c in COMMANDS]), (F.col("run_id") % len(COMMANDS) + 1).cast("int"))
    runs = _read(spark, d, "events").select(F.col("user_id").alias("run_id")).distinct().withColumn("command", pick)
    return C.decided(runs, argv=C.fields(F.col("command")))


def ledger(spark: SparkSession, d: str) -> DataFrame:
    raw = F.round(F.abs("value") * 100).cast("long")
    filters = F.when(F.col("event_id") % 3 > 0, F.array(F.lit("dedup"))).otherwise(F.array().cast("array<string>"))
    return _read(spark, d, "events").select(
        F.col("ts").alias("time"), _command().alias("command"), filters.alias("filters"), raw.alias("raw_bytes"), F.expr("cast(round(abs(value) * 100) as bigint) * (event_id % 7) div 5").alias("out_bytes")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _per_line(name: str, column: Callable, sql: str, lines: Callable = event_lines, base: str = EVT) -> None:
    _add(name, lambda s, d: lines(s, d).select("run_id", "line_no", column(F.col("text")).alias("value")), f"SELECT run_id, line_no, {sql} AS value FROM ({base})")


def _like(pattern: str, what: str = "text") -> str:
    return f"regexp_matches({what}, {_q(pattern)})"


_TRIMMED = r"regexp_replace(text, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"
_SHAPE = r"regexp_replace(text, '[ \t]+$', '')"
for _p, _b in P.SHAPES:
    _SHAPE = f"regexp_replace({_SHAPE}, {_q(_p)}, {_q(_b)}, 'g')"
_FAIL = f"({_like(P.STACK_FRAME)} OR {_like(P.FAILURE, f'regexp_replace(text, {_q(P.URL_TOKEN)}, {_q(" ")}, {_q("g")})')})"
_CLEAN = f"regexp_replace(text, {_q(P.ESCAPES)}, '', 'g')"
_REDRAW = r"CASE WHEN contains({0}, chr(13)) THEN coalesce(list_extract(list_filter(string_split({0}, chr(13)), lambda x: trim(x) <> ''), -1), '') ELSE {0} END"
_PROGRESS = f"({_TRIMMED} <> '' AND ({_like(P.PROGRESS_BAR, _TRIMMED)} OR {_like(P.PROGRESS_FIGURE, _TRIMMED)}))"

_per_line("normalize_eol", L.normalize_eol, r"regexp_replace(text, '\r$', '')")
_per_line("strip_ansi", L.strip_ansi, _CLEAN)
_per_line("resolve_redraw", L.resolve_redraw, _REDRAW.format("text"))
_per_line("is_progress", L.is_progress, _PROGRESS)
_per_line("is_failure", L.is_failure, _FAIL)
_per_line("is_stack_frame", L.is_stack_frame, _like(P.STACK_FRAME))
_per_line("needs_context", L.needs_context, f"{_FAIL} AND NOT {_like(P.SELF_CONTAINED)}")
_per_line("is_block_start", L.is_block_start, _like(P.BLOCK_START))
_per_line("is_block_end", L.is_block_end, _like(P.BLOCK_END))
_per_line("is_failure_detail", L.is_failure_detail, _like(P.DETAIL))
_per_line("indent_of", L.indent_of, r"length(regexp_extract(text, '^[ \t]*'))", doc_lines, DOC)
_per_line("is_blank", L.is_blank, "trim(text) = ''")
_per_line("is_log_noise", L.is_log_noise, _like(P.LOG_NOISE))
_per_line("similarity_key", L.similarity_key, _SHAPE)
_per_line("similarity_key_docs", L.similarity_key, _SHAPE, doc_lines, DOC)
_per_line("dedup_key", L.dedup_key, f"CASE WHEN {_like(P.LOG_NOISE)} THEN {_SHAPE} ELSE text END")
_per_line("estimate_tokens", L.estimate_tokens, "CASE WHEN strlen(text) = 0 THEN 0 ELSE greatest(1, strlen(text) // 4) END", doc_lines, DOC)
_per_line("human_bytes", lambda t: L.human_bytes(F.octet_length(t).cast("long") * 7919), "CASE WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0) ELSE n || ' B' END", doc_lines, f"SELECT *, strlen(text) * 7919 AS n FROM ({DOC})")
_per_line("thousands", lambda t: L.thousands(F.octet_length(t) * 7919), "format('{:,}', strlen(text) * 7919)", doc_lines, DOC)
_per_line("sample_text", L.sample_text, f"CASE WHEN strlen({_TRIMMED}) > 70 THEN substr({_TRIMMED}, 1, 70) || '…' ELSE {_TRIMMED} END")
_per_line("plural_times", lambda t: F.concat(L.times(F.length(t) % 3), F.lit(" "), L.plural(F.length(t) % 3, "line")), "'×' || (length(text) % 3) || ' ' || CASE WHEN length(text) % 3 = 1 THEN 'line' ELSE 'lines' END")
_per_line("file_line_refs", lambda t: F.array_join(L.file_line_refs(t), ","), f"array_to_string(regexp_extract_all(text, {_q(P.FILE_LINE)}), ',')")
_per_line("is_marker", lambda t: L.is_marker(t, "npm"), r"starts_with(regexp_replace(text, '^[ \t]+', ''), 'npm')")


def _per_call(name: str, column: Callable, sql: str | None = None) -> None:
    _add(name, lambda s, d: C.decided(calls(s, d), value=column(F.col("command"))).select("call_id", "value"), sql and f"SELECT call_id, {sql} AS value FROM ({CMD})")


def _picked(values: list) -> str:
    """A value for each command, by hand."""
    as_sql = lambda v: str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return f"list_extract([{', '.join(map(as_sql, values))}], cast(call_id % {len(COMMANDS)} + 1 as int))"


_ALL = range(len(COMMANDS))
_REASONS = [next((r for r, own in REASON_OF.items() if i in own), "handled here") for i in _ALL]
_WORDS = r"list_filter(regexp_split_to_array(command, '\s+'), lambda x: x <> '')"


def _base(word: str, suffixes: str = "exe cmd bat ps1") -> str:
    out = rf"lower(regexp_extract({word}, '[^/\\]*$'))"
    for s in suffixes.split():
        out = rf"regexp_replace({out}, '\.{s}$', '')"
    return out


_per_call("short_command", L.short_command, r"CASE WHEN strlen(trim(regexp_replace(command, '\s+', ' ', 'g'))) > 80 THEN substr(trim(regexp_replace(command, '\s+', ' ', 'g')), 1, 77) || '…' ELSE trim(regexp_replace(command, '\s+', ' ', 'g')) END")
_per_call("archive_label", L.archive_label, r"""coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(regexp_extract(regexp_replace(trim(command), '/+$', ''), '[^/]*$'), '[^A-Za-z0-9_-]+', '-', 'g'), '^-+', ''), 1, 24), '^-+|-+$', '', 'g'), ''), 'cmd')""")
_per_call("base_command", C.base_command, _base("command"))
_per_call(
    "command_words", lambda c: F.array_join(C.command_words(C.fields(c)), " "),
    f"""CASE command WHEN 'bash -c npm test' THEN 'bash npm -c npm test' WHEN 'sh -c pytest && echo done' THEN 'sh pytest -c pytest && echo done'
    ELSE array_to_string(list_transform({_WORDS}, lambda w: {_base('w')}), ' ') END""",
)
_per_call("classify_kind", lambda c: C.classify_kind(C.fields(c)), _picked(KIND_OF))
_per_call("is_query_segment", lambda c: C.is_query_segment(C.fields(c)), _picked([i in QUERIES_BY_WORDS for i in _ALL]))
_per_call("is_query_command", lambda c: C.is_query_command(C.fields(c)), _picked([k == "query" for k in KIND_OF]))
_per_call("is_pipeline_sink", lambda c: C.is_pipeline_sink(C.fields(c)), f"len({_WORDS}) > 0 AND list_contains({list(C.SINKS)}, {_base(f'coalesce({_WORDS}[1], {_q(str())})')})")
_per_call("split_segments", lambda c: F.array_join(C.split_segments(c), "\n"), _picked(["\n".join(SEGMENTS.get(i, (COMMANDS[i],))) for i in _ALL]))
_per_call("split_words", lambda c: F.array_join(C.split_words(c), "\n"), rf"array_to_string(list_filter({_WORDS}, lambda x: x <> '' AND NOT (regexp_matches(x, '^[A-Za-z0-9_]+=') AND starts_with(command, 'FOO'))), chr(10))")
_per_call("normalize_runner", lambda c: F.array_join(C.normalize_runner(C.split_words(c)), " "), _picked([PEELED.get(i, COMMANDS[i]) for i in _ALL]))
_per_call("is_long_running", lambda c: C.is_long_running(C.split_words(c)), _picked([i in LONG for i in _ALL]))
_per_call("is_interactive_docker", lambda c: C.is_interactive_docker(C.split_words(c)), "command = 'docker run -it app'")
_per_call("redirects_all", C.redirects_all, "contains(command, '&>') OR contains(command, '>&') OR (contains(command, '>') AND contains(command, '2>&1'))")
_per_call("shell_quote", C.shell_quote, "'''' || replace(command, '''', '''\\''''') || ''''")
_per_call("wrap_command", C.wrap_command, "'millrace run -- bash -c ' || '''' || replace(command, '''', '''\\''''') || ''''")
_KEY = f"""CASE WHEN len(w) = 0 THEN '(empty)' WHEN NOT list_contains({list(C.TWO_WORDS)}, {_base('w[1]', 'exe cmd bat')}) THEN w[1]
 WHEN len(w) > 2 AND w[2] IN ('run', 'exec') THEN array_to_string(w[1:3], ' ') ELSE array_to_string(w[1:2], ' ') END"""
_KEYED = f"SELECT *, CASE WHEN len(v) > 2 AND {_base('v[1]', 'exe cmd bat')} IN ('bash', 'sh', 'zsh', 'dash') AND v[2] = '-c' THEN v[3:] ELSE v END AS w FROM (SELECT *, {_WORDS} AS v FROM ({{0}}))"
_add("command_key", lambda s, d: C.decided(calls(s, d), value=C.command_key(F.col("command"))).select("call_id", "value"), f"SELECT call_id, {_KEY} AS value FROM ({_KEYED.format(CMD)})")
_add("wrap_decision", lambda s, d: C.decided(calls(s, d), x=C.wrap_decision(F.col("command"))).select("call_id", "x.wrap", "x.reason"), f"SELECT call_id, reason = 'handled here' AS wrap, reason FROM (SELECT event_id AS call_id, {_picked(_REASONS).replace('call_id', 'event_id')} AS reason FROM events)")
_add("wrap_summary", lambda s, d: C.decided(calls(s, d), reason=C.wrap_decision(F.col("command"))["reason"], kind=C.classify_kind(C.fields(F.col("command")))).groupBy("reason", "kind").agg(F.count("*").alias("n")), f"SELECT reason, kind, count(*) AS n FROM (SELECT {_picked(_REASONS).replace('call_id', 'event_id')} AS reason, {_picked(KIND_OF).replace('call_id', 'event_id')} AS kind FROM events) GROUP BY ALL")


def _deferred(s: SparkSession, d: str) -> DataFrame:
    c = calls(s, d)
    claims = c.where("call_id % 2 = 0").select("command").distinct()
    return C.deferred_to_other(c, claims).select("call_id", "deferred")


_CLAIMED = COMMANDS[::2]
_add("deferred_to_other", _deferred, f"SELECT call_id, {_picked([bool(SEGMENTS.get(i, (c,))) and all(x in _CLAIMED for x in SEGMENTS.get(i, (c,))) for i, c in enumerate(COMMANDS)])} AS deferred FROM ({CMD})")


def _tool_calls(s: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("call_id") % 5 == 0, "Read").otherwise("Bash")
    given = F.struct(F.col("command"), F.lit(30).alias("timeout"), F.lit("why").alias("description"))
    whole = F.to_json(F.struct(name.alias("tool_name"), given.alias("tool_input"), F.lit("/src").alias("cwd")))
    return calls(s, d).select("call_id", F.when(F.col("call_id") % 11 == 0, F.substring(whole, 1, 20)).otherwise(whole).alias("payload"))


_WRAPPED = "'millrace run -- bash -c ' || '''' || replace(command, '''', '''\\''''') || ''''"
_add(
    "rewrite_tool_call", lambda s, d: C.rewrite_tool_call(_tool_calls(s, d)),
    f"""SELECT call_id, '{{"hookSpecificOutput":{{"hookEventName":"PreToolUse","updatedInput":{{"command":' || to_json({_WRAPPED}) || ',"timeout":30,"description":"why"}}}}}}' AS reply
    FROM ({CMD}) WHERE call_id % 5 <> 0 AND call_id % 11 <> 0 AND {_picked(_REASONS)} = 'handled here'""",
)

# Ordered stages over the lines of events.
_SHOW = ["run_id", "pos", "src", "text", "protected", "in_block", "dropped_by", "marker"]


def _stage(name: str, fn: Callable[[DataFrame], DataFrame], sql: str | None = None, show: list[str] = _SHOW) -> None:
    numbered = S.dense if "pos" in show else lambda df: df
    _add(name, lambda s, d: numbered(fn(S.start(event_lines(s, d)))).select(*show), sql)


_FRAME = f"SELECT run_id, line_no AS pos, line_no AS src, {_REDRAW.format('(' + _CLEAN + ')')} AS text FROM ({EVT})"
_stage(
    "collapse_progress", S.collapse_progress,
    f"""SELECT run_id, pos, src, text, false AS protected, false AS in_block, CASE WHEN k = lead(k) OVER (PARTITION BY run_id ORDER BY pos) THEN 'ansi' END AS dropped_by, false AS marker
    FROM (SELECT *, CASE WHEN {_PROGRESS} THEN {_SHAPE} END AS k FROM ({_FRAME}))""",
)
_INDENT = "length(regexp_extract(text, '^[ \t]*'))"
#: The block scan, one line of every run a step.
_BLOCKS = f"""f AS MATERIALIZED (SELECT *, trim(text) = '' AS blank, {_like(P.BLOCK_START)} AS header, {_like(P.BLOCK_END)} AS ends, {_like(P.DETAIL)} OR {_FAIL} AS detail, {_INDENT} AS indent FROM ({EVT})),
    b(run_id, line_no, number, inside, depth) AS (
      SELECT DISTINCT run_id, 0::bigint, 0::bigint, false, 0::bigint FROM f
      UNION ALL
      SELECT run_id, line_no, number + (NOT stays AND header AND NOT ends)::bigint, stays OR (header AND NOT ends), CASE WHEN stays THEN depth WHEN header AND NOT ends THEN indent ELSE 0 END
      FROM (SELECT f.*, b.number, b.depth, b.inside AND (f.blank OR (NOT f.ends AND (f.indent > b.depth OR (NOT f.header AND f.detail)))) AS stays FROM b JOIN f ON f.run_id = b.run_id AND f.line_no = b.line_no + 1)),
    blocks AS (SELECT run_id, line_no AS pos, line_no AS src, text, blank, CASE WHEN inside THEN number END AS block FROM b JOIN f USING (run_id, line_no))"""
_stage("failure_blocks", S.failure_blocks, f"WITH RECURSIVE {_BLOCKS} SELECT run_id, pos, src, text, block FROM blocks", ["run_id", "pos", "src", "text", "block"])
_NUMBERED = "SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY a, o) AS pos, src, text, protected, in_block, dropped_by, marker"
_MARK = "NULL AS src, {0} AS text, false AS protected, false AS in_block, NULL AS dropped_by, true AS marker"
_plural = lambda n, word: f"{n} || CASE WHEN {n} = 1 THEN ' {word}' ELSE ' {word}s' END"
_stage(
    "cap_blocks", lambda df: S.cap_blocks(S.failure_blocks(df), Config(max_block=3)),
    f"""WITH RECURSIVE {_BLOCKS},
    w AS (SELECT *, max(CASE WHEN NOT blank THEN pos END) OVER (PARTITION BY run_id, block) AS last, row_number() OVER (PARTITION BY run_id, block ORDER BY pos) AS n FROM blocks),
    x AS (SELECT *, block IS NOT NULL AND pos <= last AS body, block IS NOT NULL AND pos <= last AND NOT blank AND n > 3 AS over FROM w),
    y AS (SELECT *, sum(over::int) OVER (PARTITION BY run_id, block) AS gone FROM x),
    r AS (SELECT run_id, pos AS a, 0 AS o, src, text, block IS NOT NULL AS protected, body AND NOT over AS in_block, CASE WHEN over THEN 'guard' END AS dropped_by, false AS marker FROM y
      UNION ALL SELECT run_id, pos, 1, {_MARK.format("'[millrace] ' || " + _plural("gone", "line") + " || ' elided from this failure; see the full output log'")} FROM y WHERE block IS NOT NULL AND pos = last AND gone > 0)
    {_NUMBERED} FROM r""",
)
_W = "OVER (PARTITION BY run_id ORDER BY line_no ROWS BETWEEN"
_stage(
    "context_window",
    lambda df: S.context_window(df.withColumn("block", F.lit(None).cast("long")).withColumn("region", F.lit(False)), CFG),
    f"""WITH f AS (SELECT *, {_FAIL} AS fail, {_FAIL} AND NOT {_like(P.SELF_CONTAINED)} AS need FROM ({EVT})),
    g AS (SELECT *, coalesce(max(need) {_W} 1 FOLLOWING AND 2 FOLLOWING), false) AS near, sum(need::int) OVER (PARTITION BY run_id ORDER BY line_no) AS g FROM f),
    h AS (SELECT *, sum((NOT fail)::int) OVER (PARTITION BY run_id, g ORDER BY line_no) AS c FROM g)
    SELECT run_id, line_no AS pos, line_no AS src, text, fail OR near OR (g > 0 AND NOT fail AND c <= 2) AS protected FROM h""",
    ["run_id", "pos", "src", "text", "protected"],
)
_stage(
    "drop_install_noise", lambda df: S.drop_install_noise(df, CFG),
    f"""WITH f AS (SELECT *, NOT {_like(P.INSTALL_SUMMARY)} AND {_like(P.INSTALL_DEPRECATED)} AS old, NOT {_like(P.INSTALL_SUMMARY)} AND NOT {_like(P.INSTALL_DEPRECATED)} AND {_like(P.INSTALL_NOISE)} AS noise FROM ({EVT})),
    g AS (SELECT run_id, count(*) + 1 AS a, sum(old::int) AS x, sum(noise::int) AS y FROM f GROUP BY run_id),
    r AS (SELECT run_id, line_no AS a, 0 AS o, line_no AS src, text, false AS protected, false AS in_block, CASE WHEN old OR noise THEN 'node-install' END AS dropped_by, false AS marker FROM f
      UNION ALL SELECT run_id, a, 0, {_MARK.format("'[millrace] dropped ' || concat_ws(' and ', CASE WHEN x > 0 THEN x || ' deprecation warnings' END, CASE WHEN y > 0 THEN y || ' progress/notice lines' END)")} FROM g WHERE x + y > 0)
    {_NUMBERED} FROM r""",
)
_stage(
    "drop_dotnet_noise", lambda df: S.drop_dotnet_noise(df, CFG),
    f"""WITH e AS (SELECT *, NOT {_like(P.DOTNET_KEEP)} AS free, {_like(P.DOTNET_RESTORED)} AS r, {_like(P.DOTNET_BUILT)} AS b, {_like(P.DOTNET_CHATTER)} AS c FROM ({EVT})),
    f AS (SELECT *, free AND r AS restored, free AND NOT r AND b AS built, free AND NOT r AND NOT b AND c AS chatter FROM e),
    g AS (SELECT run_id, count(*) + 1 AS a, sum(restored::int) AS x, sum(built::int) AS y FROM f GROUP BY run_id),
    r AS (SELECT run_id, line_no AS a, 0 AS o, line_no AS src, text, false AS protected, false AS in_block, CASE WHEN restored OR built OR chatter THEN 'dotnet' END AS dropped_by, false AS marker FROM f
      UNION ALL SELECT run_id, a, 0, {_MARK.format("'[millrace] restored ' || " + _plural("x", "project"))} FROM g WHERE x > 0
      UNION ALL SELECT run_id, a, 1, {_MARK.format("'[millrace] built ' || " + _plural("y", "project"))} FROM g WHERE y > 0)
    {_NUMBERED} FROM r""",
)
_stage("detect_test_output", S.detect_test_output, f"""SELECT run_id, line_no AS pos, coalesce(line_no >= min(CASE WHEN {_like(P.TEST_MARKER)} THEN line_no END) OVER (PARTITION BY run_id), false) AS detected FROM ({EVT})""", ["run_id", "pos", "detected"])
_stage(
    "drop_passing_tests", lambda df: S.drop_passing_tests(df, CFG),
    f"""WITH RECURSIVE f AS MATERIALIZED (SELECT *, {_like(P.TEST_FAILING)} AS failing, trim(text) = '' OR {_FAIL} AS solid, {_INDENT} AS indent, {_like(P.TEST_FAILURE)} AS fail, {_like(P.TEST_HEADER)} AS head,
        {_like(P.TEST_SUMMARY)} OR NOT {_like(P.TEST_PASS)} AS stays, {_like(P.TAP_RESULT)} AS tap FROM ({EVT})),
    s(run_id, line_no, failure, late, hush, gone) AS (
      SELECT DISTINCT run_id, 0::bigint, false, false, -1::bigint, 0 FROM f
      UNION ALL
      SELECT run_id, line_no, CASE WHEN failing OR late OR hushed THEN failure ELSE fail OR (failure AND NOT head) END, late OR failing,
        CASE WHEN failing OR (hushed AND NOT late) THEN hush WHEN goes AND tap THEN indent ELSE -1 END, CASE WHEN failing OR late THEN 0 WHEN hushed THEN 2 WHEN goes THEN 1 ELSE 0 END
      FROM (SELECT f.*, s.failure, s.late, s.hush, NOT f.failing AND NOT s.late AND s.hush >= 0 AND NOT f.solid AND f.indent > s.hush AS hushed,
          NOT f.failing AND NOT s.late AND NOT (s.hush >= 0 AND NOT f.solid AND f.indent > s.hush) AND NOT f.fail AND NOT (s.failure AND NOT f.head) AND NOT f.stays AS goes
        FROM s JOIN f ON f.run_id = s.run_id AND f.line_no = s.line_no + 1)),
    g AS (SELECT run_id, count(*) AS a, count(*) FILTER (gone = 1) AS n FROM s GROUP BY run_id),
    r AS (SELECT run_id, line_no AS a, 0 AS o, line_no AS src, text, false AS protected, false AS in_block, CASE WHEN gone > 0 THEN 'test-runner' END AS dropped_by, false AS marker FROM s JOIN f USING (run_id, line_no)
      UNION ALL SELECT run_id, a, 0, {_MARK.format("'[millrace] dropped ' || " + _plural("n", "passing-test line"))} FROM g WHERE n > 0)
    {_NUMBERED} FROM r""",
)
_CELL = "PARTITION BY run_id, id, epoch"
_LAYER = "' of layer/progress output elided'"
_stage(
    "docker_steps", lambda df: S.docker_steps(df, Config(max_step=1)),
    f"""WITH f AS (SELECT run_id, line_no AS pos, text, trim(text) = '' AS blank, CASE WHEN {_like(P.STEP_LINE)} THEN regexp_extract(text, {_q(P.STEP_LINE)}, 1) END AS id, regexp_extract(text, {_q(P.STEP_LINE)}, 2) AS rest FROM ({EVT})),
    e AS (SELECT *, CASE WHEN id IS NULL THEN NULL WHEN {_like(P.STEP_DONE, 'rest')} THEN 'D' WHEN {_like(P.STEP_ERROR, 'rest')} THEN 'E' WHEN {_like(P.STEP_HEADER, 'rest')} THEN 'H' END AS ev,
      {_like(P.STEP_PROGRESS, 'rest')} OR (SELECT {_PROGRESS} FROM (SELECT rest AS text)) AS moving FROM f),
    o AS (SELECT *, id IS NOT NULL AND coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY run_id, id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'H', false) AS open FROM e),
    p AS (SELECT *, coalesce(ev = 'H' AND NOT open, false) AS opens, open AND coalesce(ev IN ('D', 'E'), false) AS status FROM o),
    q AS (SELECT *, sum(opens::int) OVER (PARTITION BY run_id, id ORDER BY pos) AS epoch, open OR opens AS mine, open AND NOT status AND moving AS prog, open AND NOT status AND NOT moving AS body FROM p),
    s AS (SELECT *, body AND coalesce(sum(body::int) OVER ({_CELL} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 1 AS fit FROM q),
    t AS (SELECT *, max(CASE WHEN status THEN pos END) OVER ({_CELL}) AS done, coalesce(bool_or(status AND ev = 'E') OVER ({_CELL}), false) AS bad, sum((fit OR prog)::int) OVER ({_CELL}) AS n,
      sum(prog::int) OVER ({_CELL}) AS progs, sum((body AND NOT fit)::int) OVER ({_CELL}) AS over, min(CASE WHEN opens THEN pos END) OVER (PARTITION BY run_id, id) AS first FROM s),
    u AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN NOT mine THEN pos WHEN done IS NOT NULL THEN done ELSE 1000000000000 + first END, CASE WHEN NOT mine OR opens THEN 0 WHEN status THEN 3 ELSE 1 END, pos) AS a,
      (mine AND (prog OR (body AND NOT fit) OR (open AND NOT status AND done IS NOT NULL AND NOT bad))) OR (id IS NULL AND blank) AS gone FROM t),
    v AS (SELECT *, max(CASE WHEN mine THEN a END) OVER ({_CELL}) AS tail FROM u),
    r AS (SELECT run_id, a, 0 AS o, pos AS src, text, false AS protected, false AS in_block, CASE WHEN gone THEN 'docker-build' END AS dropped_by, false AS marker FROM v
      UNION ALL SELECT run_id, a - 1, 1, {_MARK.format("'#' || id || ' [millrace] ' || " + _plural("n", "line") + " || " + _LAYER)} FROM v WHERE status AND NOT bad AND n > 0
      UNION ALL SELECT run_id, a - 1, 1, {_MARK.format("'#' || id || ' [millrace] ' || over || ' further ' || CASE WHEN over = 1 THEN 'line' ELSE 'lines' END || ' elided; see the full output log'")} FROM v WHERE status AND bad AND over > 0
      UNION ALL SELECT run_id, a, 1, {_MARK.format("'#' || id || ' [millrace] ' || " + _plural("progs", "line") + " || " + _LAYER)} FROM v WHERE mine AND done IS NULL AND a = tail AND progs > 0)
    {_NUMBERED} FROM r""",
)


def _collapsed(source: str, src: str = "b.pos", kept: str = "false", far: str = "true", also: str = "") -> str:
    """CTEs f to r: ``source`` (run_id, pos dense in a run, text) after the collapse of runs and repeats; r in order a, o.

    kept: lines that are left alone besides failures; far: where repeats at a distance go too; also: columns of a line that are handed on.
    """
    more = f"(SELECT CASE WHEN strlen({_TRIMMED}) > 70 THEN substr({_TRIMMED}, 1, 70) || '…' ELSE {_TRIMMED} END FROM (SELECT t AS text))"
    further = f"'[millrace] ×' || extra || CASE WHEN extra = 1 THEN ' further similar line: ' ELSE ' further similar lines: ' END || {more}"
    return f"""f AS (SELECT *, NOT {_FAIL} AND NOT ({kept}) AS free, trim(text) = '' AS blank, CASE WHEN {_like(P.LOG_NOISE)} THEN {_SHAPE} ELSE text END AS k FROM ({source})),
    a AS (SELECT *, NOT (free AND coalesce(lag(free) OVER w AND lag(k) OVER w = k, false)) AS new FROM f WINDOW w AS (PARTITION BY run_id ORDER BY pos)),
    b AS (SELECT *, sum(new::int) OVER w AS isle, CASE WHEN coalesce(lead(free) OVER w, false) THEN pos + 1 ELSE pos END AS ends FROM a WINDOW w AS (PARTITION BY run_id ORDER BY pos)),
    i AS (SELECT run_id, isle, count(*) AS c, min(pos) AS pos, max(pos) AS stop, max(ends) AS flush, arg_min(text, pos) AS t, arg_min(k, pos) AS k, bool_and(free AND NOT blank) AS lead, bool_and({far}) AS far FROM b GROUP BY run_id, isle),
    j AS (SELECT *, coalesce(far AND c < 3 AND strlen(t) >= 24 AND flush - lag(flush) OVER (PARTITION BY run_id, k ORDER BY pos) <= 50, false) AS near FROM i WHERE lead),
    l AS (SELECT *, near AND coalesce(sum(CASE WHEN near THEN 2 ELSE 1 END) OVER (PARTITION BY run_id, k ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 > 2 AS sup FROM j),
    m AS (SELECT *, sum(CASE WHEN sup THEN c ELSE 0 END) OVER (PARTITION BY run_id, k) AS extra, row_number() OVER (PARTITION BY run_id, k ORDER BY pos) AS nth FROM l),
    r AS (
      SELECT b.run_id, b.pos AS a, 0 AS o, {src} AS src, CASE WHEN m.c < 3 THEN m.t ELSE b.text END AS text, {'b.prot' if also else 'false'} AS protected, false AS in_block,
        CASE WHEN (b.free AND b.blank AND NOT b.new) OR (m.c >= 3 AND NOT b.new) OR coalesce(m.sup, false) THEN 'dedup' END AS dropped_by, false AS marker
      FROM b LEFT JOIN m ON m.run_id = b.run_id AND m.isle = b.isle
      UNION ALL SELECT run_id, stop, 1, {_MARK.format("'[millrace] ×' || c || ' similar lines collapsed'")} FROM m WHERE c >= 3
      UNION ALL SELECT run_id, 1000000000000, pos, {_MARK.format(further)} FROM m WHERE nth = 1 AND extra > 0)"""


_stage("dedup_lines", lambda df: S.dedup(df, CFG), f"WITH {_collapsed(f'SELECT *, line_no AS pos FROM ({EVT})')} {_NUMBERED} FROM r")
_add(
    "collapse_runs_docs", lambda s, d: S.dedup(S.start(doc_lines(s, d)), Config(window=0, min_run=2)).where("NOT marker AND dropped_by = 'dedup'").select("run_id", "src"),
    f"""WITH f AS (SELECT *, NOT {_FAIL} AS free, CASE WHEN {_like(P.LOG_NOISE)} THEN {_SHAPE} ELSE text END AS k FROM ({DOC}))
    SELECT run_id, line_no AS src FROM (SELECT *, free AND coalesce(lag(free) OVER w AND lag(k) OVER w = k, false) AS again FROM f WINDOW w AS (PARTITION BY run_id ORDER BY line_no)) WHERE again""",
)


def _head_tail(s: SparkSession, d: str) -> DataFrame:
    out = S.head_tail(S.start(doc_lines(s, d)), Config(head=3, tail=4))
    return out.where("dropped_by IS NULL").select("run_id", F.row_number().over(Window.partitionBy("run_id").orderBy("pos")).cast("long").alias("out_no"), "text", "marker")


_add(
    "head_tail", _head_tail,
    f"""WITH n AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS c FROM ({DOC})),
    k AS (SELECT run_id, line_no * 2 AS o, text, false AS marker FROM n WHERE line_no <= 3 OR line_no > greatest(3, c - 4)
      UNION ALL SELECT run_id, 7, '[millrace] ... ' || (c - 7) || CASE WHEN c - 7 = 1 THEN ' line' ELSE ' lines' END || ' elided ...', true FROM n WHERE line_no = 4 AND c > 7)
    SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY o) AS out_no, text, marker FROM k""",
)


# The plan and what it says about runs.
def _staged(s: SparkSession, d: str) -> DataFrame:
    return K.staged(event_lines(s, d), event_runs(s, d), CFG)


def _note(text: str, src: str = "NULL") -> str:
    return f"{src} AS src, '[millrace] ' || {text} AS text, false AS prot, false AS inb"


_KIND = f"list_extract([{', '.join(_q(k) for k in KIND_OF)}], cast(run_id % {len(COMMANDS)} + 1 as int))"
_DENSE = "row_number() OVER (PARTITION BY run_id ORDER BY a, o) AS n"
#: The whole plan over the lines of events, live lines from stage to stage, with the lines that each stage drops. No block
#: or build step of these runs reaches its cap.
_PLAN = rf"""base AS MATERIALIZED (SELECT run_id, line_no, text AS raw, regexp_replace(text, '\r$', '') AS clean, {_KIND} AS kind FROM ({EVT})),
    size AS MATERIALIZED (SELECT run_id, any_value(kind) AS kind, count(*) AS raw_lines, cast(sum(strlen(raw) + 1) as bigint) AS raw_bytes, cast(sum(strlen(clean) + 1) as bigint) AS clean_bytes FROM base GROUP BY run_id),
    t0 AS (SELECT *, CASE WHEN {_PROGRESS} THEN {_SHAPE} END AS k0 FROM (
      SELECT base.*, {_REDRAW.format('(' + _CLEAN.replace('text', 'clean') + ')')} AS text FROM base JOIN size USING (run_id) WHERE NOT (raw_lines <= 40 AND raw_bytes <= 2048))),
    t1 AS (SELECT *, coalesce(k0 = lead(k0) OVER (PARTITION BY run_id ORDER BY line_no), false) AS moved FROM t0),
    a1 AS MATERIALIZED (SELECT run_id, kind, line_no AS src, text, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS n, trim(text) = '' AS blank, {_FAIL} AS fail, {_like(P.SELF_CONTAINED)} AS alone,
      {_like(P.BLOCK_START)} AS header, {_like(P.BLOCK_END)} AS ends, {_like(P.DETAIL)} OR {_FAIL} AS detail, {_INDENT} AS indent FROM t1 WHERE NOT moved),
    s1(run_id, n, number, inside, depth) AS (
      SELECT DISTINCT run_id, 0::bigint, 0::bigint, false, 0::bigint FROM a1
      UNION ALL
      SELECT run_id, n, number + (NOT stays AND header AND NOT ends)::bigint, stays OR (header AND NOT ends), CASE WHEN stays THEN depth WHEN header AND NOT ends THEN indent ELSE 0 END
      FROM (SELECT a1.*, s1.number, s1.depth, s1.inside AND (a1.blank OR (NOT a1.ends AND (a1.indent > s1.depth OR (NOT a1.header AND a1.detail)))) AS stays FROM s1 JOIN a1 ON a1.run_id = s1.run_id AND a1.n = s1.n + 1)),
    b1 AS (SELECT a1.*, CASE WHEN inside THEN number END AS block FROM a1 JOIN s1 USING (run_id, n)),
    b2 AS (SELECT *, max(CASE WHEN NOT blank THEN n END) OVER (PARTITION BY run_id, block) AS last, fail AND NOT alone AND block IS NULL AS need, lag(block) OVER w AS pb FROM b1 WINDOW w AS (PARTITION BY run_id ORDER BY n)),
    b3 AS (SELECT *, need OR (block IS NOT NULL AND coalesce(pb <> block, true)) AS trig, need OR (pb IS NOT NULL AND coalesce(pb <> block, true)) AS resets FROM b2),
    b4 AS (SELECT *, block IS NULL AND coalesce(max(trig) OVER (PARTITION BY run_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND {CFG.before} FOLLOWING), false) AS near, sum(resets::int) OVER (PARTITION BY run_id ORDER BY n) AS g, block IS NULL AND NOT fail AS cand FROM b3),
    b5 AS (SELECT *, sum(cand::int) OVER (PARTITION BY run_id, g ORDER BY n) AS c FROM b4),
    a2 AS MATERIALIZED (SELECT run_id, kind, n, src, text, blank, fail, indent, coalesce(block IS NOT NULL OR near OR fail OR (g > 0 AND cand AND c <= {CFG.after}), false) AS prot, coalesce(block IS NOT NULL AND n <= last, false) AS inb FROM b5),
    i1 AS (SELECT *, kind IN ('node-install', 'node-script') AND NOT prot AND NOT {_like(P.INSTALL_SUMMARY)} AS free, {_like(P.INSTALL_DEPRECATED)} AS old_, {_like(P.INSTALL_NOISE)} AS noise_ FROM a2),
    i2 AS (SELECT *, free AND old_ AS old, free AND NOT old_ AND noise_ AS noise FROM i1),
    i3 AS (SELECT run_id, any_value(kind) AS kind, sum(old::int) AS x, sum(noise::int) AS y FROM i2 GROUP BY run_id),
    a3 AS MATERIALIZED (SELECT *, {_DENSE} FROM (
      SELECT run_id, kind, n AS a, 0 AS o, src, text, prot, inb FROM i2 WHERE NOT old AND NOT noise
      UNION ALL SELECT run_id, kind, 1000000000000, 0, {_note("'dropped ' || concat_ws(' and ', CASE WHEN x > 0 THEN x || ' deprecation warnings' END, CASE WHEN y > 0 THEN y || ' progress/notice lines' END)")} FROM i3 WHERE x + y > 0)),
    d1 AS (SELECT *, n >= min(CASE WHEN kind = 'node-script' AND {_like(P.TEST_MARKER)} THEN n END) OVER (PARTITION BY run_id) AS seen FROM a3),
    d2 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n) AS m, {_like(P.TEST_FAILING)} AS failing, trim(text) = '' OR prot OR {_FAIL} AS solid, {_INDENT} AS indent, {_like(P.TEST_FAILURE)} AS fail, {_like(P.TEST_HEADER)} AS head,
      prot OR {_like(P.TEST_SUMMARY)} OR NOT {_like(P.TEST_PASS)} AS stays, {_like(P.TAP_RESULT)} AS tap FROM d1 WHERE coalesce(seen, false)),
    s2(run_id, m, failure, late, hush, gone) AS (
      SELECT DISTINCT run_id, 0::bigint, false, false, -1::bigint, 0 FROM d2
      UNION ALL
      SELECT run_id, m, CASE WHEN failing OR late OR inb OR hushed THEN failure ELSE fail OR (failure AND NOT head) END, late OR failing,
        CASE WHEN failing OR (hushed AND NOT late) THEN hush WHEN goes AND tap THEN indent ELSE -1 END, CASE WHEN failing OR late THEN 0 WHEN hushed THEN 2 WHEN goes THEN 1 ELSE 0 END
      FROM (SELECT d2.*, s2.failure, s2.late, s2.hush, NOT d2.failing AND NOT s2.late AND NOT d2.inb AND s2.hush >= 0 AND NOT d2.solid AND d2.indent > s2.hush AS hushed,
          NOT d2.failing AND NOT s2.late AND NOT d2.inb AND NOT (s2.hush >= 0 AND NOT d2.solid AND d2.indent > s2.hush) AND NOT d2.fail AND NOT (s2.failure AND NOT d2.head) AND NOT d2.stays AS goes
        FROM s2 JOIN d2 ON d2.run_id = s2.run_id AND d2.m = s2.m + 1)),
    d3 AS (SELECT d2.run_id, d2.n, s2.gone FROM s2 JOIN d2 USING (run_id, m) WHERE s2.gone > 0),
    d4 AS (SELECT run_id, count(*) FILTER (gone = 1) AS x FROM d3 GROUP BY run_id),
    a4 AS MATERIALIZED (SELECT *, {_DENSE} FROM (
      SELECT run_id, kind, n AS a, 0 AS o, src, text, prot, inb FROM a3 WHERE NOT EXISTS (SELECT 1 FROM d3 WHERE d3.run_id = a3.run_id AND d3.n = a3.n)
      UNION ALL SELECT run_id, 'node-script', 1000000000000, 0, {_note("'dropped ' || x || CASE WHEN x = 1 THEN ' passing-test line' ELSE ' passing-test lines' END")} FROM d4 WHERE x > 0)),
    e1 AS (SELECT *, kind = 'docker-build' AS on_, CASE WHEN kind = 'docker-build' AND {_like(P.STEP_LINE)} THEN regexp_extract(text, {_q(P.STEP_LINE)}, 1) END AS id, regexp_extract(text, {_q(P.STEP_LINE)}, 2) AS rest FROM a4),
    e2 AS (SELECT *, CASE WHEN id IS NULL THEN NULL WHEN {_like(P.STEP_DONE, 'rest')} THEN 'D' WHEN {_like(P.STEP_ERROR, 'rest')} THEN 'E' WHEN {_like(P.STEP_HEADER, 'rest')} THEN 'H' END AS ev,
      {_like(P.STEP_PROGRESS, 'rest')} OR (SELECT {_PROGRESS} FROM (SELECT rest AS text)) AS moving FROM e1),
    e3 AS (SELECT *, id IS NOT NULL AND coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY run_id, id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'H', false) AS open FROM e2),
    e4 AS (SELECT *, coalesce(ev = 'H' AND NOT open, false) AS opens, open AND coalesce(ev IN ('D', 'E'), false) AS status FROM e3),
    e5 AS (SELECT *, sum(opens::int) OVER (PARTITION BY run_id, id ORDER BY n) AS epoch, open OR opens AS mine, open AND NOT status AS held FROM e4),
    e6 AS (SELECT *, max(CASE WHEN status THEN n END) OVER c AS done, coalesce(bool_or(mine AND ((held AND prot) OR (status AND ev = 'E'))) OVER c, false) AS bad, sum((held AND (NOT moving OR prot))::int) OVER c AS x, sum((held AND moving AND NOT prot)::int) OVER c AS progs,
      min(CASE WHEN opens THEN n END) OVER (PARTITION BY run_id, id) AS first, max(CASE WHEN mine THEN n END) OVER c AS tail FROM e5 WINDOW c AS (PARTITION BY run_id, id, epoch)),
    e7 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN NOT mine THEN n WHEN done IS NOT NULL THEN done ELSE 1000000000000 + first END, CASE WHEN NOT mine OR opens THEN 0 WHEN status THEN 3 ELSE 1 END, n) AS place,
      (mine AND held AND ((moving AND NOT prot) OR (done IS NOT NULL AND NOT bad))) OR (on_ AND id IS NULL AND trim(text) = '' AND NOT prot) AS gone FROM e6),
    a5 AS MATERIALIZED (SELECT *, {_DENSE} FROM (
      SELECT run_id, kind, place AS a, 0 AS o, src, text, prot, inb FROM e7 WHERE NOT gone
      UNION ALL SELECT run_id, kind, place - 1, 1, NULL, '#' || id || ' [millrace] ' || {_plural('(x + progs)', 'line')} || {_LAYER}, false, false FROM e7 WHERE status AND NOT bad AND x + progs > 0
      UNION ALL SELECT run_id, kind, place, 1, NULL, '#' || id || ' [millrace] ' || {_plural('progs', 'line')} || {_LAYER}, false, false FROM e7 WHERE mine AND done IS NULL AND n = tail AND progs > 0)),
    f1 AS (SELECT *, kind = 'dotnet' AND NOT prot AND NOT {_like(P.DOTNET_KEEP)} AS own, {_like(P.DOTNET_RESTORED)} AS r, {_like(P.DOTNET_BUILT)} AS u, {_like(P.DOTNET_CHATTER)} AS h FROM a5),
    f2 AS (SELECT run_id, sum((own AND r)::int) AS x, sum((own AND NOT r AND u)::int) AS y FROM f1 GROUP BY run_id),
    a6 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY a, o) AS pos FROM (
      SELECT run_id, kind, n AS a, 0 AS o, src, text, prot, inb FROM f1 WHERE NOT (own AND (r OR u OR h))
      UNION ALL SELECT run_id, 'dotnet', 1000000000000, 0, {_note("'restored ' || " + _plural('x', 'project'))} FROM f2 WHERE x > 0
      UNION ALL SELECT run_id, 'dotnet', 1000000000000, 1, {_note("'built ' || " + _plural('y', 'project'))} FROM f2 WHERE y > 0)),
    {_collapsed('SELECT * FROM a6', 'b.src', 'prot OR inb', "kind <> 'query'", 'prot')},
    n1 AS (SELECT r.*, kind, row_number() OVER (PARTITION BY run_id ORDER BY a, o) AS n, count(*) OVER (PARTITION BY run_id) AS alive FROM r JOIN size USING (run_id) WHERE dropped_by IS NULL),
    n2 AS (SELECT *, greatest({CFG.head}, alive - {CFG.tail}) AS tail, kind <> 'query' AND n > {CFG.head} AND n <= greatest({CFG.head}, alive - {CFG.tail}) AS mid FROM n1),
    n3 AS MATERIALIZED (SELECT *, sum((mid AND NOT protected)::int) OVER (PARTITION BY run_id) AS skip, sum((mid AND protected)::int) OVER (PARTITION BY run_id) AS held FROM n2),
    live AS MATERIALIZED (SELECT run_id, src, text, protected AS prot, row_number() OVER (PARTITION BY run_id ORDER BY a, o) AS n FROM (
      SELECT run_id, n AS a, 0 AS o, src, text, protected FROM n3 WHERE NOT mid OR protected
      UNION ALL SELECT run_id, n, -1, NULL, '[millrace] ... ' || {_plural('skip', 'line')} || CASE WHEN held > 0 THEN ' elided; failures from the middle follow ...' ELSE ' elided ...' END, false FROM n3 WHERE mid AND n = {CFG.head + 1} AND skip > 0
      UNION ALL SELECT run_id, n, -1, NULL, '[millrace] ... resuming at the last ' || {_plural('(alive - tail)', 'line')} || ' ...', false FROM n3 WHERE kind <> 'query' AND n = tail + 1 AND skip > 0 AND held > 0)),
    gone AS MATERIALIZED (
      SELECT run_id, line_no AS src, 'ansi' AS stage FROM t1 WHERE moved
      UNION ALL SELECT run_id, src, 'node-install' FROM i2 WHERE old OR noise
      UNION ALL SELECT run_id, src, 'test-runner' FROM a3 JOIN d3 USING (run_id, n)
      UNION ALL SELECT run_id, src, 'docker-build' FROM e7 WHERE gone
      UNION ALL SELECT run_id, src, 'dotnet' FROM f1 WHERE own AND (r OR u OR h)
      UNION ALL SELECT run_id, src, 'dedup' FROM r WHERE dropped_by IS NOT NULL
      UNION ALL SELECT run_id, src, 'truncate' FROM n3 WHERE mid AND NOT protected),
    x1 AS (SELECT run_id, count(*) AS n_out, cast(sum(strlen(text) + 1) as bigint) AS b_out, bool_or(src IS NULL) AS marked FROM live GROUP BY run_id),
    x2 AS (SELECT run_id, bool_or(text <> clean) AS rewritten FROM t1 GROUP BY run_id),
    x3 AS (SELECT run_id, list_sort(list_distinct(list(stage))) AS stages FROM gone GROUP BY run_id),
    plan AS MATERIALIZED (
      SELECT *, x AND NOT (raw_bytes <= 1048576 AND b_out + CASE WHEN changed THEN strlen(foot) + 1 ELSE 0 END >= raw_bytes) AS used FROM (
        SELECT *, '[millrace] ' || CASE WHEN raw_lines > n_out THEN (raw_lines - n_out) || ' lines elided' ELSE 'output rewritten' END || ' — full output: run ' || run_id AS foot FROM (
          SELECT size.*, x1.run_id IS NOT NULL AS x, n_out, b_out, coalesce(marked OR rewritten OR len(stages) > 0, false) AS changed, coalesce(rewritten, false) AS rewritten, coalesce(stages, []) AS stages
          FROM size LEFT JOIN x1 USING (run_id) LEFT JOIN x2 USING (run_id) LEFT JOIN x3 USING (run_id))))"""
_STATS = f"""SELECT run_id, kind, raw_lines AS lines_in, CASE WHEN used THEN n_out ELSE raw_lines END AS lines_out, CASE WHEN used THEN clean_bytes ELSE raw_bytes END AS bytes_in, CASE WHEN used THEN b_out ELSE raw_bytes END AS bytes_out,
    raw_bytes, used AS filtered, CASE WHEN used THEN list_filter(['ansi', 'guard', 'node-install', 'test-runner', 'docker-build', 'dotnet', 'dedup', 'truncate'], lambda s: list_contains(stages, s) OR (s = 'ansi' AND rewritten)) ELSE [] END AS filters FROM plan"""
_KEPT = """SELECT run_id, n AS out_no, src AS src_line_no, text, src IS NULL AS is_marker, prot AS protected FROM live JOIN plan USING (run_id) WHERE used
    UNION ALL SELECT run_id, n_out + 1, NULL, foot, true, false FROM plan WHERE used AND changed
    UNION ALL SELECT run_id, line_no, line_no, raw, false, prot FROM base JOIN plan USING (run_id) LEFT JOIN (SELECT run_id, src AS line_no, prot FROM a2) USING (run_id, line_no) WHERE NOT used"""


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("filters", F.array_join("filters", ","))


_add("compact_stats", lambda s, d: _joined(K.run_stats(_staged(s, d))), f"WITH RECURSIVE {_PLAN} SELECT * REPLACE (array_to_string(filters, ',') AS filters) FROM ({_STATS})")
_add("compact_kept", lambda s, d: K.kept_lines(_staged(s, d), CFG), f"WITH RECURSIVE {_PLAN} SELECT * REPLACE (coalesce(protected, false) AS protected) FROM ({_KEPT})")
_add("compact_elided", lambda s, d: K.elided(_staged(s, d)), f"WITH RECURSIVE {_PLAN} SELECT run_id, src AS line_no, raw AS text, stage FROM gone JOIN plan USING (run_id) JOIN base ON base.run_id = gone.run_id AND base.line_no = gone.src WHERE used")
_stage(
    "guard", lambda df: S.guard(S.collapse_progress(df), CFG),
    f"""WITH RECURSIVE {_PLAN.replace('JOIN size USING (run_id) WHERE NOT (raw_lines <= 40 AND raw_bytes <= 2048)', 'JOIN size USING (run_id)', 1)}
    SELECT run_id, line_no AS pos, line_no AS src, text, coalesce(prot, false) AS protected, coalesce(inb, false) AS in_block, CASE WHEN moved THEN 'ansi' END AS dropped_by, false AS marker
    FROM t1 LEFT JOIN (SELECT run_id, src AS line_no, prot, inb FROM a2) USING (run_id, line_no)""",
)


def _document_stats(s: SparkSession, d: str) -> DataFrame:
    lines = doc_lines(s, d)
    runs = lines.select("run_id").distinct().withColumn("argv", F.array(F.lit("make")))
    return K.run_stats(K.staged(lines, runs, CFG)).withColumn("filters", F.array_join("filters", ","))


#: The whole plan over documents, in which no line is a failure, opens a block or needs context.
_SOURCE = f"""SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS pos FROM (
    SELECT *, coalesce(k0 = lead(k0) OVER (PARTITION BY run_id ORDER BY line_no), false) AS moved FROM (
      SELECT *, CASE WHEN {_PROGRESS} THEN {_SHAPE} END AS k0 FROM (
        SELECT run_id, line_no, clean, {_REDRAW.format('(' + _CLEAN.replace('text', 'clean') + ')')} AS text FROM big))) WHERE NOT moved"""
_add(
    "compact_documents", _document_stats,
    f"""WITH base AS MATERIALIZED (SELECT run_id, line_no, text AS raw, regexp_replace(text, '\r$', '') AS clean FROM ({DOC})),
    size AS (SELECT run_id, count(*) AS lines_in, cast(sum(strlen(raw) + 1) as bigint) AS raw_bytes, cast(sum(strlen(clean) + 1) as bigint) AS clean_bytes FROM base GROUP BY run_id),
    big AS (SELECT base.* FROM base JOIN size USING (run_id) WHERE NOT (lines_in <= 40 AND raw_bytes <= 2048)),
    {_collapsed(_SOURCE)},
    n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY a, o) AS n, count(*) OVER (PARTITION BY run_id) AS alive FROM r WHERE dropped_by IS NULL),
    cut AS (SELECT run_id, count(*) FILTER (NOT mid) AS stay, count(*) FILTER (mid) AS skip, sum(strlen(text) + 1) FILTER (NOT mid) AS bytes FROM (SELECT *, n > {CFG.head} AND n <= greatest({CFG.head}, alive - {CFG.tail}) AS mid FROM n) GROUP BY run_id),
    hit AS (SELECT r.run_id, bool_or(r.marker) AS marked, bool_or(r.dropped_by IS NOT NULL) AS collapsed, bool_or(coalesce(f.text <> f.clean, false)) AS rewritten FROM r LEFT JOIN f ON f.run_id = r.run_id AND f.pos = r.src GROUP BY r.run_id),
    x AS (SELECT size.*, coalesce(cut.stay + (skip > 0)::int, lines_in) AS n_out, cast(coalesce(bytes + CASE WHEN skip > 0 THEN strlen('[millrace] ... ' || {_plural('skip', 'line')} || ' elided ...') + 1 ELSE 0 END, raw_bytes) as bigint) AS b_out,
      cut.run_id IS NULL AS small, coalesce(skip > 0, false) AS cut_, coalesce(marked, false) AS marked, coalesce(collapsed, false) AS collapsed, coalesce(rewritten OR lines_in > (SELECT count(*) FROM f WHERE f.run_id = size.run_id), false) AND cut.run_id IS NOT NULL AS cleaned
      FROM size LEFT JOIN cut USING (run_id) LEFT JOIN hit USING (run_id)),
    y AS (SELECT *, NOT small AND NOT (raw_bytes <= 1048576 AND b_out + CASE WHEN cut_ OR marked OR collapsed OR cleaned THEN strlen('[millrace] ' || CASE WHEN lines_in > n_out THEN (lines_in - n_out) || ' lines elided' ELSE 'output rewritten' END || ' — full output: run ' || run_id) + 1 ELSE 0 END >= raw_bytes) AS used FROM x)
    SELECT run_id, 'generic' AS kind, lines_in, CASE WHEN used THEN n_out ELSE lines_in END AS lines_out, CASE WHEN used THEN clean_bytes ELSE raw_bytes END AS bytes_in, CASE WHEN used THEN b_out ELSE raw_bytes END AS bytes_out, raw_bytes, used AS filtered,
      CASE WHEN used THEN concat_ws(',', CASE WHEN cleaned THEN 'ansi' END, CASE WHEN collapsed THEN 'dedup' END, CASE WHEN cut_ THEN 'truncate' END) ELSE '' END AS filters FROM y""",
)
_add(
    "savings_line", lambda s, d: K.savings_line(K.run_stats(_staged(s, d))),
    f"""WITH RECURSIVE {_PLAN}, z AS ({_STATS})
    SELECT run_id, printf('%d -> %d lines, ~%s -> ~%s tok (-%.0f%%)', lines_in, lines_out, format('{{:,}}', greatest(1, bytes_in // 4)), format('{{:,}}', greatest(1, bytes_out // 4)), CASE WHEN bytes_in > 0 THEN greatest(0.0, 100.0 * (bytes_in - bytes_out) / bytes_in) ELSE 0.0 END) AS line FROM z""",
)
_add(
    "passthrough", lambda s, d: K.passthrough(doc_lines(s, d)),
    f"SELECT run_id, count(*) AS raw_lines, cast(sum(strlen(text) + 1) as bigint) AS raw_bytes, count(*) <= 40 AND sum(strlen(text) + 1) <= 2048 AS small FROM ({DOC}) GROUP BY run_id",
)

# Audits of the plan's output, in which violations are planted by a rule that both sides apply: every 29th source line is
# taken out of the output, and one run in ten reports more bytes than it has.
_PLANTED = f"kept AS MATERIALIZED ({_KEPT}), planted AS MATERIALIZED (SELECT * FROM kept WHERE src_line_no IS NULL OR src_line_no % 29 <> 3), stats AS (SELECT * REPLACE (CASE WHEN run_id % 10 = 3 THEN bytes_out + 100000 ELSE bytes_out END AS bytes_out) FROM ({_STATS}))"


def _tidy(source: str) -> str:
    """``source`` with ``shown``, its text as far as it may be tidied."""
    return f"SELECT *, {_REDRAW.format('(' + _CLEAN.replace('text', 'eol') + ')')} AS shown FROM (SELECT *, regexp_replace(text, '\r$', '') AS eol FROM {source})"


_SHOWN_FAIL = _FAIL.replace("text", "shown")


def _audit(name: str, fn: Callable, sql: str) -> None:
    def query(s: SparkSession, d: str) -> DataFrame:
        lines, runs = event_lines(s, d), event_runs(s, d)
        done = K.staged(lines, runs, CFG)
        planted = K.kept_lines(done, CFG).where("src_line_no IS NULL OR src_line_no % 29 <> 3")
        stats = K.run_stats(done).withColumn("bytes_out", F.when(F.col("run_id") % 10 == 3, F.col("bytes_out") + 100000).otherwise(F.col("bytes_out")))
        return fn(lines, runs, planted, stats)

    _add(name, query, f"WITH RECURSIVE {_PLAN}, {_PLANTED} {sql}")


_audit(
    "audit_failures_survive", lambda lines, runs, kept, stats: A.failures_survive(lines, kept),
    f"""SELECT run_id, line_no, text, CASE WHEN out_no IS NULL THEN 'missing' ELSE 'out of order' END AS problem FROM (
      SELECT need.*, out_no, lag(out_no) OVER (PARTITION BY need.run_id, out_no IS NULL ORDER BY line_no) AS above FROM (SELECT * FROM ({_tidy(f'({EVT})')}) WHERE {_SHOWN_FAIL}) need
      LEFT JOIN planted ON planted.run_id = need.run_id AND src_line_no = line_no) WHERE out_no IS NULL OR above >= out_no""",
)
_audit(
    "audit_failures_aligned", lambda lines, runs, kept, stats: A.failures_survive(lines, kept.drop("src_line_no")),
    f"""SELECT run_id, line_no, text, CASE WHEN out_no IS NULL THEN 'missing' ELSE 'out of order' END AS problem FROM (
      SELECT *, max(out_no) OVER (PARTITION BY run_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM (
        SELECT run_id, line_no, shown AS text, row_number() OVER (PARTITION BY run_id, shown ORDER BY line_no) AS nth FROM ({_tidy(f'({EVT})')}) WHERE {_SHOWN_FAIL})
      LEFT JOIN (SELECT run_id, out_no, shown AS text, row_number() OVER (PARTITION BY run_id, shown ORDER BY out_no) AS nth FROM ({_tidy('planted')}) WHERE {_SHOWN_FAIL}) USING (run_id, text, nth))
    WHERE out_no IS NULL OR out_no < above""",
)
_audit(
    "audit_block_gaps", lambda lines, runs, kept, stats: A.block_gaps(lines, kept),
    f"""SELECT run_id, after_line, before_line FROM (
      SELECT run_id, line_no AS before_line, lag(line_no) OVER h AS after_line, m, lag(m) OVER h AS pm FROM (
        SELECT run_id, line_no, head, max((line_no > head AND indent <= depth)::int) OVER (PARTITION BY run_id, head ORDER BY line_no) AS shallow FROM (
          SELECT *, first_value(indent) OVER (PARTITION BY run_id, head ORDER BY line_no) AS depth FROM (
            SELECT *, {_INDENT} AS indent, last_value(CASE WHEN {_like(P.BLOCK_START)} AND NOT {_like(P.BLOCK_END)} THEN line_no END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY line_no) AS head FROM ({EVT}))) WHERE head IS NOT NULL)
      JOIN (SELECT run_id, src_line_no AS line_no, sum(is_marker::int) OVER (PARTITION BY run_id ORDER BY out_no) AS m FROM planted) USING (run_id, line_no)
      WHERE shallow = 0 AND line_no IS NOT NULL WINDOW h AS (PARTITION BY run_id, head ORDER BY line_no)) WHERE before_line > after_line + 1 AND m = pm""",
)
_audit(
    "audit_silent_gaps", lambda lines, runs, kept, stats: A.silent_gaps(lines, kept.drop("src_line_no", "is_marker")),
    rf""", q0 AS MATERIALIZED (SELECT *, {_like(A.AUDIT_HEADER, 'shown')} AS head, CASE WHEN trim(shown) = '' THEN coalesce(lead({_INDENT.replace('text', 'shown')}) OVER (PARTITION BY run_id ORDER BY line_no), -1) ELSE {_INDENT.replace('text', 'shown')} END AS indent FROM ({_tidy(f'({EVT})')})),
    q1(run_id, line_no, number, depth) AS (
      SELECT DISTINCT run_id, 0::bigint, 0::bigint, NULL::bigint FROM q0
      UNION ALL
      SELECT run_id, line_no, number + (NOT stays AND head)::int, CASE WHEN stays THEN depth WHEN head THEN indent END FROM (SELECT q0.*, number, depth, coalesce(q0.indent > depth, false) AS stays FROM q1 JOIN q0 ON q0.run_id = q1.run_id AND q0.line_no = q1.line_no + 1)),
    q2 AS (SELECT q0.run_id, q0.line_no, shown, min(q0.line_no) OVER g AS header_no, row_number() OVER (PARTITION BY q0.run_id, number ORDER BY q0.line_no) - 1 AS j, count(*) OVER g AS size FROM q1 JOIN q0 USING (run_id, line_no) WHERE depth IS NOT NULL WINDOW g AS (PARTITION BY q0.run_id, number)),
    q3 AS MATERIALIZED (SELECT *, starts_with(ltrim(shown), '[millrace]') AS mark, max(out_no) OVER (PARTITION BY run_id) AS last FROM ({_tidy('planted')})),
    q4 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY out_no) AS m, lag(out_no) OVER (PARTITION BY run_id ORDER BY out_no) AS after, max(out_no) OVER (PARTITION BY run_id) AS fin FROM q3 WHERE NOT mark),
    q5 AS (SELECT h.run_id, h.line_no AS header_no, m, last, fin FROM (SELECT *, row_number() OVER (PARTITION BY run_id, shown ORDER BY line_no) AS nth FROM q0 WHERE head) h
      JOIN (SELECT *, row_number() OVER (PARTITION BY run_id, shown ORDER BY out_no) AS nth FROM q4 WHERE {_like(A.AUDIT_HEADER, 'shown')}) o USING (run_id, shown, nth)),
    q6 AS (SELECT q2.run_id, q2.header_no, q2.line_no, q2.shown, q4.out_no, q4.after, q5.last, q5.fin, row_number() OVER (PARTITION BY q2.run_id, q2.header_no ORDER BY j) AS nth
      FROM q2 JOIN q5 ON q5.run_id = q2.run_id AND q5.header_no = q2.header_no LEFT JOIN q4 ON q4.run_id = q2.run_id AND q4.m = q5.m + j WHERE size > 1 AND q4.shown IS DISTINCT FROM q2.shown)
    SELECT run_id, header_no, line_no, shown AS text FROM q6 WHERE nth = 1 AND NOT coalesce(CASE WHEN out_no IS NULL THEN last > fin ELSE out_no > after + 1 END, false)""",
)
_audit("audit_never_grows", lambda lines, runs, kept, stats: A.never_grows(stats), "SELECT run_id, raw_bytes, bytes_out FROM stats WHERE bytes_out > raw_bytes")
_audit("audit_no_escapes", lambda lines, runs, kept, stats: A.no_escapes(kept), "SELECT run_id, out_no, text FROM planted WHERE contains(text, chr(27)) OR contains(text, chr(13))")
_SIGNED = r"^\s*[-+]|Error|ok \d"
_counted = lambda source: f"SELECT run_id, text, count(*) AS n FROM {source} WHERE {_like(_SIGNED)} GROUP BY ALL"
_audit(
    "audit_multiset", lambda lines, runs, kept, stats: A.multiset(lines, kept, _SIGNED),
    f"SELECT run_id, text, i.n AS n_in, coalesce(o.n, 0) AS n_out FROM ({_counted(f'({EVT})')}) i LEFT JOIN ({_counted('planted')}) o USING (run_id, text) WHERE i.n > coalesce(o.n, 0)",
)
#: What a kind's runs must save at least, above what most do.
FLOORS = {"node-install": 0.3, "node-script": 0.1, "docker-build": 0.05, "dotnet": 0.05, "generic": 0.02, "query": 0.0}
_audit(
    "audit_savings_floor",
    lambda lines, runs, kept, stats: A.savings_floor(stats, stats.select("run_id", F.element_at(F.create_map(*[F.lit(x) for kv in FLOORS.items() for x in kv]), F.col("kind")).alias("min_saving"))),
    f"""SELECT run_id, saving, min_saving FROM (SELECT run_id, CASE WHEN raw_bytes > 0 THEN 1.0::double - bytes_out / raw_bytes ELSE 0.0 END AS saving,
      CASE kind {' '.join(f"WHEN '{k}' THEN {v}::double" for k, v in FLOORS.items())} END AS min_saving FROM stats) WHERE saving < min_saving""",
)
_audit(
    "audit_must_keep", lambda lines, runs, kept, stats: A.must_keep(kept, lines.where(L.is_failure(_SHOWN := A._shown(F.col("text")))).select("run_id", F.trim(_SHOWN).alias("needle")).distinct()),
    f"""SELECT run_id, needle FROM (SELECT DISTINCT run_id, trim(shown, ' ') AS needle FROM ({_tidy(f'({EVT})')}) WHERE {_SHOWN_FAIL}) r
    WHERE NOT EXISTS (SELECT 1 FROM planted p WHERE p.run_id = r.run_id AND contains(p.text, r.needle))""",
)
_shaped = lambda source: f"SELECT run_id, text, CASE WHEN {_PROGRESS} THEN {_SHAPE} WHEN {_like(P.LOG_NOISE)} THEN {_SHAPE} ELSE text END AS shape FROM (SELECT run_id, shown AS text FROM ({_tidy(source)}))"
_audit(
    "audit_queries_complete", lambda lines, runs, kept, stats: A.queries_complete(lines, kept, runs.withColumn("kind", F.when(C.is_query_command(F.col("argv")), "query"))),
    f"""SELECT i.run_id, min(i.text) AS text FROM ({_shaped(f'({EVT})')}) i WHERE i.run_id IN (SELECT run_id FROM size WHERE kind = 'query')
      AND NOT EXISTS (SELECT 1 FROM ({_shaped('planted')}) k WHERE k.run_id = i.run_id AND k.shape = i.shape) GROUP BY i.run_id, i.shape""",
)



def _numbered_blocks(source: str) -> str:
    return rf"""SELECT run_id, block_no, regexp_replace(string_agg(text, chr(10) ORDER BY place), '\s+$', '') AS body FROM (
      SELECT *, count(*) FILTER (regexp_matches(text, '^\s*\d+\)\s')) OVER (PARTITION BY run_id ORDER BY place) AS block_no FROM ({source})) WHERE block_no > 0 GROUP BY run_id, block_no"""


_audit(
    "audit_block_equality", lambda lines, runs, kept, stats: A.block_equality(lines, kept),
    f"""SELECT run_id, block_no, a.body AS expected, b.body AS got FROM ({_numbered_blocks(f'SELECT *, line_no AS place FROM ({EVT})')}) a
    FULL JOIN ({_numbered_blocks('SELECT *, out_no AS place FROM planted WHERE NOT is_marker')}) b USING (run_id, block_no) WHERE a.body IS DISTINCT FROM b.body""",
)


_audit(
    "diff_outputs", lambda lines, runs, kept, stats: A.diff_outputs(lines.withColumnRenamed("line_no", "out_no"), kept),
    f"SELECT run_id, out_no, a.text AS expected, b.text AS got FROM (SELECT *, line_no AS out_no FROM ({EVT})) a FULL JOIN planted b USING (run_id, out_no) WHERE a.text IS DISTINCT FROM b.text",
)

# The ledger.
_add("entry_saved", lambda s, d: _read(s, d, "events").select("event_id", G.entry_saved(F.round(F.abs("value") * 100).cast("long"), F.col("event_id")).alias("saved")), "SELECT event_id, greatest(0, cast(round(abs(value) * 100) as bigint) - event_id) AS saved FROM events")
_add(
    "ledger_totals", lambda s, d: G.ledger_totals(ledger(s, d)).drop("pct"),
    f"""SELECT *, runs - filtered_runs AS passed_through, greatest(0, raw_bytes - out_bytes) AS saved, raw_bytes // 4 AS tokens_raw_bytes, out_bytes // 4 AS tokens_out_bytes, greatest(0, raw_bytes - out_bytes) // 4 AS tokens_saved
    FROM (SELECT count(*) AS runs, count(*) FILTER (filtered) AS filtered_runs, cast(sum(raw_bytes) as bigint) AS raw_bytes, cast(sum(out_bytes) as bigint) AS out_bytes FROM ({LEDGER}))""",
)
_GROUPED = f"""SELECT command_key, count(*) AS runs, cast(sum(raw_bytes) as bigint) AS raw_bytes, cast(sum(out_bytes) as bigint) AS out_bytes, greatest(0, cast(sum(raw_bytes) - sum(out_bytes) as bigint)) AS saved
 FROM (SELECT {_KEY} AS command_key, raw_bytes, out_bytes FROM ({_KEYED.format(LEDGER)})) GROUP BY command_key"""
_add("savings_by_command", lambda s, d: G.savings_by_command(ledger(s, d)).drop("pct"), _GROUPED)
_add("top_commands", lambda s, d: G.top_commands(ledger(s, d), 10).drop("pct"), f"{_GROUPED} ORDER BY saved DESC, command_key LIMIT 10")
_HUMAN = "CASE WHEN saved >= 1073741824 THEN printf('%.1f GB', saved / 1073741824.0) WHEN saved >= 1048576 THEN printf('%.1f MB', saved / 1048576.0) WHEN saved >= 1024 THEN printf('%.1f KB', saved / 1024.0) ELSE saved || ' B' END"
_add(
    "report", lambda s, d: G.report(ledger(s, d), 10),
    f"""SELECT rank, printf('%-40s  %4d %-4s  %9s saved  (%.0f%%)', CASE WHEN strlen(command_key) > 40 THEN substr(command_key, 1, 39) || '…' ELSE command_key END, runs, CASE WHEN runs = 1 THEN 'run' ELSE 'runs' END, {_HUMAN}, pct) AS line
    FROM (SELECT *, CASE WHEN raw_bytes > 0 THEN 100.0 * saved / raw_bytes ELSE 0.0 END AS pct, cast(row_number() OVER (ORDER BY saved DESC, command_key) as int) AS rank FROM ({_GROUPED})) WHERE rank <= 10""",
)
_since = lambda d: G.parse_since("36h", datetime(2024, 1, 10))
_add("ledger_since", lambda s, d: ledger(s, d).where(F.col("time") >= F.lit(_since(d))).agg(F.count("*").alias("runs"), F.sum("raw_bytes").alias("raw_bytes")), f"SELECT count(*) AS runs, cast(sum(raw_bytes) as bigint) AS raw_bytes FROM ({LEDGER}) WHERE time >= TIMESTAMP '2024-01-08 12:00:00'")
_add(
    "savings_by_day", lambda s, d: stream_savings(ledger(s, d)).withColumn("day", F.date_format("start", "yyyy-MM-dd")).drop("start"),
    f"SELECT strftime(time, '%Y-%m-%d') AS day, count(*) AS runs, cast(sum(raw_bytes) as bigint) AS raw_bytes, cast(sum(out_bytes) as bigint) AS out_bytes, greatest(0, cast(sum(raw_bytes) - sum(out_bytes) as bigint)) AS saved FROM ({LEDGER}) GROUP BY 1",
)


# Sources.
def _chunks(s: SparkSession, d: str) -> DataFrame:
    """Conversations as byte chunks: a turn is cut in three anywhere, even inside a character."""
    raw = F.concat(F.col("text").cast("binary"), F.lit("\n").cast("binary"))
    n = F.octet_length("text") + 1
    cut = F.array(*[F.substring(raw, a, b) for a, b in ((F.lit(1), (n / 3).cast("int")), ((n / 3).cast("int") + 1, (n / 3).cast("int")), ((n / 3).cast("int") * 2 + 1, n))])
    rows = _read(s, d, "conversations").select(F.col("conv_id").alias("run_id"), "turn", F.posexplode(cut).alias("i", "data"))
    return rows.select("run_id", (F.col("turn") * 3 + F.col("i")).cast("long").alias("seq"), "data")


_add(
    "reassemble_lines", lambda s, d: T.reassemble_lines(_chunks(s, d)),
    "SELECT conv_id AS run_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS line_no, text FROM (SELECT conv_id, turn, unnest(range(len(x))) AS i, unnest(x) AS text FROM (SELECT *, string_split(text, chr(10)) AS x FROM conversations))",
)
