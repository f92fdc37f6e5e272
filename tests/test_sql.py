from pyspark.sql import functions as F

from millrace.functions import lines as L
from millrace.functions import sql
from millrace.operators import stages as S

TEXTS = [
    "  1) case", "     AssertionError: x", "info: [a] took 5 ms", "50%\r60%\r", "\x1b[31mred\x1b[0m", "", "Error: it's \"bad\" 12", "   at f (a.js:1)", "[###  ]",
    "plain", "thread 'main' panicked", "3 passing",
]


def test_sql_functions_equal_the_columns(spark):
    sql.register(spark)
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(TEXTS)], "run_id long, line_no long, text string")
    pairs = {
        "strip_ansi": L.strip_ansi, "resolve_redraw": L.resolve_redraw, "is_progress_line": L.is_progress, "is_stack_frame": L.is_stack_frame,
        "is_failure_line": L.is_failure, "is_block_start": L.is_block_start, "is_log_noise": L.is_log_noise, "similarity_key": L.similarity_key,
    }
    for r in df.select(*[F.struct(F.expr(f"{n}(text)").alias("a"), c(F.col("text")).alias("b")).alias(n) for n, c in pairs.items()]).collect():
        for n in pairs:
            assert r[n].a == r[n].b, (n, r[n])
    t = F.col("text")
    df.select(
        "run_id", "line_no", L.is_blank(t).alias("blank"), (L.is_block_start(t) & ~L.is_block_end(t)).alias("starts"), L.is_block_start(t).alias("header"),
        L.is_block_end(t).alias("ends"), (L.is_failure_detail(t) | L.is_failure(t)).alias("detail"), L.indent_of(t).alias("indent"),
    ).createOrReplaceTempView("block_input")
    got = spark.sql("SELECT line_no, block FROM failure_blocks(TABLE(block_input) PARTITION BY run_id ORDER BY line_no)").collect()
    want = S.failure_blocks(S.start(df)).select("src", "block").collect()
    assert sorted((r.line_no, r.block) for r in got) == sorted((r.src, r.block) for r in want)


def test_more_functions_equal_the_columns(spark):
    from millrace.functions import commands as C
    from millrace.functions import lines as L
    from millrace.functions import sql

    sql.register(spark)
    texts = [
        "", " ", "\t\u00a0 ", "a\r", "a\rb\r\t", "  1) x", "Error: y", "warning CS0168: unused", "12 passing", "   + x", "info: took 3 ms", "it's 'x'",
        r"C:\\tools\\Docker.exe", "/usr/bin/npm.cmd", "make > a 2>&1", "x &> y", "npm warn deprecated z", "é" * 9,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    t = sql_text = df.text
    columns = {
        "normalize_eol": L.normalize_eol(t), "is_blank_line": L.is_blank(t), "indent_of": L.indent_of(t), "needs_context": L.needs_context(t), "is_block_end": L.is_block_end(t),
        "is_failure_detail": L.is_failure_detail(t), "dedup_key": L.dedup_key(t), "estimate_tokens": L.estimate_tokens(t), "resolve_redraw": L.resolve_redraw(t),
        "base_command": C.base_command(sql_text), "redirects_all": C.redirects_all(t), "shell_quote": C.shell_quote(t),
    }
    for name, column in columns.items():
        rows = df.select("text", column.alias("a")).selectExpr("text", "a", f"{name}(text) AS b").collect()
        assert [(r.text, r.b) for r in rows if r.a != r.b] == [], name


def test_block_scan_of_a_plain_table(spark):
    from millrace.functions import sql
    from millrace.operators import stages as S

    sql.register(spark)
    texts = ["a", "  1) x", "     AssertionError: y", "      + b", "", "done", "Error: z", "  at f (a.js:1:2)", "12 passing"]
    lines = spark.createDataFrame([(r, i + 1, t) for r in (1, 2) for i, t in enumerate(texts)], "run_id long, line_no long, text string")
    lines.createOrReplaceTempView("plain_lines")
    got = {(r.run_id, r.line_no): r.block for r in spark.sql(sql.block_scan("plain_lines")).collect()}
    want = {(r.run_id, r.src): r.block for r in S.failure_blocks(S.start(lines)).collect()}
    assert got == {k: None if v is None or v != v else v for k, v in want.items()} and any(got.values())


def test_command_functions_equal_the_columns(spark):
    from millrace.catalog import COMMANDS
    from millrace.functions import commands as C

    sql.register(spark)
    more = ["bash -c 'npm ci && npm run build'", "A=1 B=2", "x 'a;b' && \"c|d\" | e", "tail -f x", "git", "docker run -it --rm x", "npm run build --watch", "sed --quiet x", "cat -f a"]
    df = spark.createDataFrame([(c,) for c in (*COMMANDS, *more)], "text string")
    t = F.col("text")
    w = C.fields(t)
    given = "command_fields(text)"
    pairs = {
        given: w, "wrap_command(text)": C.wrap_command(t), "split_segments(text)": C.split_segments(t), "split_words(text)": C.split_words(t), f"is_pipeline_sink({given})": C.is_pipeline_sink(w),
        f"is_query_segment({given})": C.is_query_segment(w), f"is_long_running({given})": C.is_long_running(w), f"is_interactive_docker({given})": C.is_interactive_docker(w),
        f"command_words({given})": C.command_words(w),
    }
    for name, column in pairs.items():
        rows = df.select("text", column.alias("a")).selectExpr("text", "a", f"{name} AS b").collect()
        assert [(r.text, r.a, r.b) for r in rows if r.a != r.b] == [], name
    script = spark.sql("SELECT command_words(array('bash', '-c', 'npm ci && (npm run \\\'x\\\')')) AS x").first().x
    assert script == ["bash", "npm", "ci", "npm", "run", "x", "-c", "npm ci && (npm run 'x')"]
