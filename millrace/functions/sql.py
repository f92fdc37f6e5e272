"""The line functions in SQL, and the block scan as a table function over any ordered table."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import commands as C
from . import patterns as P


def _text(pattern: str) -> str:
    return "r'" + P.java(pattern).replace("'", r"\x27") + "'"


def _like(pattern: str, what: str = "text") -> str:
    return f"coalesce(rlike({what}, {_text(pattern)}), false)"


def _definitions() -> dict[str, tuple[str, str]]:
    trimmed = r"regexp_replace(text, r'(?U)^\s+|\s+\z', '')"
    shape = r"regexp_replace(text, r'[ \t]+\z', '')"
    for pattern, blank in P.SHAPES:
        shape = f"regexp_replace({shape}, {_text(pattern)}, '" + blank.replace("'", "\\'") + "')"
    plain = f"regexp_replace(text, {_text(P.URL_TOKEN)}, ' ')"
    bar = "r'" + P.PROGRESS_BAR_JAVA + "'"
    fails = f"({_like(P.STACK_FRAME)} OR {_like(P.FAILURE, plain)})"
    base = r"lower(regexp_extract(text, r'[^/\\]*\z', 0))"
    for suffix in ("exe", "cmd", "bat", "ps1"):
        base = rf"regexp_replace({base}, r'\.{suffix}\z', '')"
    quoted = r"concat('\'', replace(text, '\'', '\'\\\'\''), '\'')"
    return {
        "normalize_eol": ("STRING", r"regexp_replace(text, r'\r\z', '')"),
        "is_blank_line": ("BOOLEAN", r"coalesce(rlike(text, r'(?U)^\s*\z'), false)"),
        "indent_of": ("INT", r"length(regexp_extract(text, r'^[ \t]*', 0))"),
        "needs_context": ("BOOLEAN", f"{fails} AND NOT {_like(P.SELF_CONTAINED)}"),
        "is_block_end": ("BOOLEAN", _like(P.BLOCK_END)),
        "is_failure_detail": ("BOOLEAN", _like(P.DETAIL)),
        "dedup_key": ("STRING", f"CASE WHEN {_like(P.LOG_NOISE)} THEN {shape} ELSE text END"),
        "estimate_tokens": ("BIGINT", "CASE WHEN octet_length(text) = 0 THEN 0 ELSE greatest(1, octet_length(text) div 4) END"),
        "base_command": ("STRING", base),
        "redirects_all": ("BOOLEAN", "contains(text, '&>') OR contains(text, '>&') OR (contains(text, '>') AND contains(text, '2>&1'))"),
        "shell_quote": ("STRING", quoted),
        "strip_ansi": ("STRING", f"regexp_replace(text, {_text(P.ESCAPES)}, '')"),
        "resolve_redraw": ("STRING", r"CASE WHEN contains(text, '\r') THEN coalesce(try_element_at(filter(split(text, '\r'), x -> regexp_replace(x, r'(?U)^\s+|\s+\z', '') <> ''), -1), '') ELSE text END"),
        "is_progress_line": ("BOOLEAN", f"coalesce({trimmed} <> '' AND (rlike({trimmed}, {bar}) OR rlike({trimmed}, {_text(P.PROGRESS_FIGURE)})), false)"),
        "is_stack_frame": ("BOOLEAN", _like(P.STACK_FRAME)),
        "is_failure_line": ("BOOLEAN", f"{_like(P.STACK_FRAME)} OR {_like(P.FAILURE, plain)}"),
        "is_block_start": ("BOOLEAN", _like(P.BLOCK_START)),
        "is_log_noise": ("BOOLEAN", _like(P.LOG_NOISE)),
        "similarity_key": ("STRING", shape),
    }


def _in(what: str, words: tuple[str, ...]) -> str:
    return f"coalesce({what}, '') IN ({', '.join(repr(w) for w in words)})"


def _commands() -> dict[str, tuple[str, str, str]]:
    """Functions of commands: parameter, type, body; each may use those before it."""

    def base(word: str) -> str:  # a function can't be called on a lambda's variable
        out = rf"lower(regexp_extract({word}, r'[^/\\]*\z', 0))"
        for suffix in ("exe", "cmd", "bat", "ps1"):
            out = rf"regexp_replace({out}, r'\.{suffix}\z', '')"
        return out

    first, rest = "coalesce(get(words, 0), '')", "slice(words, 2, greatest(size(words), 1))"
    sub = f"lower(get(filter({rest}, w -> NOT startswith(w, '-')), 0))"
    text, words, strings = "text STRING", "words ARRAY<STRING>", "ARRAY<STRING>"
    trim = r"regexp_replace({0}, r'(?U)^\s+|\s+\z', '')"
    edges = "regexp_replace({0}, '^[\"\\']+|[\"\\']+$', '')"
    parts = 'regexp_extract_all(text, "(?:\'[^\']*+(?:\'|\\\\z)|\\"[^\\"]*+(?:\\"|\\\\z)|[^;|&\'\\"]++)++", 0)'
    shell = f"({_in(base('a'), C.SHELLS)} AND get(words, i + 2) IS NOT NULL AND get(words, i + 1) = '-c')"
    script = f"filter(transform(filter(split(regexp_replace(x, r'&&|\\|\\||[|;()\n]', ' '), r'(?U)\\s+'), y -> y <> ''), w -> {base(edges.format('w'))}), w -> w <> '')"
    flags = "--help", "-h", "--version", "-v"
    return {
        "command_fields": (text, strings, r"filter(split(text, r'(?U)\s+'), x -> x <> '')"),
        "wrap_command": (text, "STRING", "concat('millrace run -- bash -c ', shell_quote(text))"),
        "split_segments": (text, strings, f"filter(transform({parts}, x -> {trim.format('x')}), x -> x <> '')"),
        "split_words": (
            text, strings,
            "CASE WHEN exists(command_fields(text), w -> NOT rlike(w, '^[A-Za-z0-9_]+=')) THEN slice(command_fields(text), cast(array_position(transform(command_fields(text), w -> NOT rlike(w, '^[A-Za-z0-9_]+=')), true) as int), size(command_fields(text))) "
            "ELSE cast(array() as array<string>) END",
        ),
        "is_pipeline_sink": (words, "BOOLEAN", f"size(words) > 0 AND {_in(base(first), C.SINKS)}"),
        "is_query_segment": (
            words, "BOOLEAN",
            f"""CASE WHEN size(words) < 1 THEN false WHEN exists({rest}, w -> {_in('lower(w)', flags)}) THEN true
            WHEN {_in(base(first), C.QUERY_COMMANDS)} THEN NOT exists({rest}, w -> w IN ('-f', '--follow', '-F')) WHEN {base(first)} = 'sed' THEN exists({rest}, w -> w IN ('-n', '--quiet', '--silent'))
            WHEN {base(first)} = 'git' THEN {sub} IS NULL OR {_in(sub, C.GIT_READ_ONLY)} ELSE {_in(sub, C.READ_ONLY_VERBS)} END""",
        ),
        "is_long_running": (
            words, "BOOLEAN",
            f"exists({rest}, w -> {_in('lower(w)', C.LONG_FLAGS)}) OR exists({rest}, w -> NOT startswith(w, '-') AND exists(split(lower(w), '[:\\\\-._/]'), x -> {_in('x', C.LONG_RUNNING)}))",
        ),
        "is_interactive_docker": (words, "BOOLEAN", f"{_in(base(first), ('docker', 'podman'))} AND coalesce(get(filter({rest}, w -> NOT startswith(w, '-')), 0) = 'run', false) AND NOT array_contains({rest}, '--rm')"),
        "command_words": (words, strings, f"flatten(transform(words, (a, i) -> concat(array({base('a')}), CASE WHEN {shell} THEN {script.replace('(x,', '(get(words, i + 2),')} ELSE cast(array() as array<string>) END)))"),
    }


def register(spark: SparkSession) -> list[str]:
    """Temporary SQL functions of a line's text, of a command or of its words; they are inlined into the plan, no
    Python runs."""
    for name, (kind, body) in _definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS {kind} RETURN {body}")
    for name, (given, kind, body) in _commands().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("failure_blocks", FailureBlocks)
    return [*_definitions(), *_commands(), "failure_blocks"]


def block_scan(table: str) -> str:
    """SQL for the failure blocks of ``table`` (run_id, line_no, text): run_id, line_no, block."""
    flags = (
        "is_blank_line(text) AS blank, is_block_start(text) AND NOT is_block_end(text) AS starts, is_block_start(text) AS header, "
        "is_block_end(text) AS ends, is_failure_detail(text) OR is_failure_line(text) AS detail, indent_of(text) AS indent"
    )
    return f"SELECT * FROM failure_blocks(TABLE(SELECT run_id, line_no, {flags} FROM {table}) PARTITION BY run_id ORDER BY line_no)"


@udtf(returnType="run_id bigint, line_no bigint, block bigint")
class FailureBlocks:
    """``SELECT * FROM failure_blocks(TABLE(t) PARTITION BY run_id ORDER BY line_no)``.

    t: run_id, line_no, blank, starts (header that is no summary), header, ends, detail, indent.
    """

    def __init__(self):
        self.number, self.depth = 0, None

    def eval(self, row):
        inside = self.depth is not None
        if inside and not row["blank"]:
            inside = not row["ends"] and (row["indent"] > self.depth or (not row["header"] and row["detail"]))
        if not inside:
            self.depth = None
            if row["starts"]:
                self.number, self.depth, inside = self.number + 1, row["indent"], True
        yield row["run_id"], row["line_no"], self.number if inside else None
