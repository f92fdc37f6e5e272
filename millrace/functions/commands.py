"""Column functions over commands: argv or word arrays, command lines, tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lines import _trim

# The words that decide how a command is classed.
SHELLS = ("bash", "sh", "zsh", "dash")
MANAGERS = ("npm", "pnpm", "yarn", "bun")
INSTALLS = ("install", "i", "ci", "add", "update", "upgrade", "remove", "rm", "uninstall", "dedupe", "prune")
DOCKERS, DOTNETS = ("docker", "podman", "buildx"), ("dotnet", "msbuild")
QUERY_COMMANDS = (
    "cat", "bat", "glow", "jq", "yq", "head", "tail", "awk", "column", "gh", "env", "printenv", "pwd", "which", "whereis",
    "date", "hostname", "uname", "id", "whoami", "groups", "locale", "nproc", "arch", "realpath", "readlink", "basename",
    "dirname", "stat", "file", "ps", "df", "du", "lsof", "netstat", "ss", "mount", "lsblk", "free", "uptime", "ifconfig",
    "ip", "dig", "nslookup", "host", "sysctl", "tree", "shasum", "sha256sum", "md5sum",
)
READ_ONLY_VERBS = (
    "list", "ls", "show", "get", "describe", "info", "view", "inspect", "status", "diff", "tree", "search", "why", "explain",
    "outdated", "freeze", "env", "version", "help", "config", "metadata", "graph", "blame", "history", "cat", "print", "dump",
    "export", "report", "summary", "stat", "stats", "versions", "where", "path", "images", "ps", "top", "licenses", "audit",
    "bin", "root", "prefix", "output", "whoami", "log",
)
GIT_READ_ONLY = (
    "log", "show", "diff", "status", "blame", "annotate", "reflog", "shortlog", "describe", "rev-parse", "rev-list",
    "ls-files", "ls-tree", "ls-remote", "cat-file", "show-ref", "for-each-ref", "whatchanged", "count-objects", "var", "grep",
    "branch", "tag", "remote", "config", "notes", "stash", "worktree", "submodule", "bisect", "verify-commit", "verify-tag",
    "name-rev", "check-ignore",
)
SINKS = ("head", "tail", "grep", "wc", "jq", "rg", "sort", "uniq", "cut", "column")
KNOWN_TOOLS = (
    "jest", "vitest", "mocha", "ava", "tap", "pytest", "cargo", "tsc", "eslint", "biome", "prettier", "nyc", "c8", "tsx",
    "esbuild", "vite", "webpack", "rollup",
)
LONG_RUNNING = ("dev", "start", "watch", "serve", "develop", "preview", "repl", "console", "attach", "logs", "tail")
LONG_FLAGS = ("--watch", "-w", "--serve", "--dev", "-it", "-ti", "--interactive", "--tty", "--follow", "-f")
RUNNERS = ("npx", "bunx", "pnpx")
TWO_WORDS = ("npm", "pnpm", "yarn", "bun", "dotnet", "docker", "git", "go", "cargo")

KINDS = ("node-install", "node-script", "docker-build", "dotnet", "query", "generic")
_NONE = lambda: F.array().cast("array<string>")


def base_command(word: Column, suffixes: tuple[str, ...] = (".exe", ".cmd", ".bat", ".ps1")) -> Column:
    """Last path part on either separator, lower case, without Windows endings."""
    out = F.lower(F.regexp_extract(word, r"[^/\\]*\z", 0))
    for s in suffixes:
        out = F.regexp_replace(out, "\\" + s + r"\z", "")
    return out


def fields(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def _rest(words: Column, start: int = 2) -> Column:
    return F.when(F.size(words) >= start, F.slice(words, start, F.size(words))).otherwise(_NONE())


def _first(words: Column) -> Column:
    return F.coalesce(F.get(words, F.lit(0)), F.lit(""))


def _subcommand(words: Column) -> Column:
    """First word after the command that is no flag, lower case; null if there is none."""
    return F.lower(F.get(F.filter(_rest(words), lambda w: ~F.startswith(w, F.lit("-"))), F.lit(0)))


def script_words(script: Column) -> Column:
    plain = F.regexp_replace(script, r"&&|\|\||[|;()\n]", " ")
    bases = F.transform(fields(plain), lambda w: base_command(F.regexp_replace(w, r"""^["']+|["']+\z""", "")))
    return F.filter(bases, lambda w: w != "")


def command_words(argv: Column) -> Column:
    """Base names of argv; behind ``sh -c`` also the words of the script."""

    def one(a: Column, i: Column) -> Column:
        script = F.get(argv, i + 2)
        inner = base_command(a).isin(*SHELLS) & script.isNotNull() & (F.get(argv, i + 1) == "-c")
        return F.concat(F.array(base_command(a)), F.when(inner, script_words(script)).otherwise(_NONE()))

    return F.flatten(F.transform(argv, one))


def is_query_segment(words: Column) -> Column:
    cmd, rest, sub = base_command(_first(words)), _rest(words), _subcommand(words)
    asks = F.exists(rest, lambda w: F.lower(w).isin("--help", "-h", "--version", "-v"))
    follows = F.exists(rest, lambda w: w.isin("-f", "--follow", "-F"))
    return (
        F.when(F.size(words) < 1, False).when(asks, True).when(cmd.isin(*QUERY_COMMANDS), ~follows)
        .when(cmd == "sed", F.exists(rest, lambda w: w.isin("-n", "--quiet", "--silent")))
        .when(cmd == "git", sub.isNull() | sub.isin(*GIT_READ_ONLY))
        .otherwise(F.coalesce(sub.isin(*READ_ONLY_VERBS), F.lit(False)))
    )


def is_pipeline_sink(words: Column) -> Column:
    return (F.size(words) > 0) & base_command(_first(words)).isin(*SINKS)


def is_query_command(argv: Column) -> Column:
    """Whether any segment is a query or a sink; ``sh -c`` is looked through, quotes are not minded."""
    at = F.array_position(
        F.transform(argv, lambda a, i: base_command(a).isin(*SHELLS) & F.get(argv, i + 2).isNotNull() & (F.get(argv, i + 1) == "-c")), F.lit(True)
    )
    script = F.get(argv, (at + 1).cast("int"))
    parts = F.filter(F.transform(F.split(F.regexp_replace(script, r"&&|\|\||[|;]", "\n"), "\n"), fields), lambda x: F.size(x) > 0)
    segments = F.when(at > 0, parts).otherwise(F.array(argv))
    return (F.size(argv) > 0) & F.exists(segments, lambda s: is_query_segment(s) | is_pipeline_sink(s))


def classify_kind(argv: Column) -> Column:
    words = command_words(argv)
    at = F.array_position(F.transform(words, lambda w: w.isin(*MANAGERS)), F.lit(True))
    sub = F.get(F.filter(F.slice(words, F.greatest(at, F.lit(1)).cast("int") + 1, F.size(words) + 1), lambda w: ~F.startswith(w, F.lit("-"))), F.lit(0))
    tool = F.get(F.filter(words, lambda w: w.isin(*DOCKERS, *DOTNETS)), F.lit(0))
    return (
        F.when(is_query_command(argv), "query").when((at > 0) & (sub.isNull() | sub.isin(*INSTALLS, "")), "node-install")
        .when(at > 0, "node-script").when(tool.isin(*DOCKERS), "docker-build").when(tool.isin(*DOTNETS), "dotnet").otherwise("generic")
    )


def split_segments(command: Column) -> Column:
    """Commands of a line, split on ; | & && || outside quotes, trimmed, without empty ones."""
    pieces = F.regexp_extract_all(command, F.lit(r"""(?:'[^']*+(?:'|\z)|"[^"]*+(?:"|\z)|[^;|&'"]++)++"""), F.lit(0))
    return F.filter(F.transform(pieces, _trim), lambda x: x != "")


def split_words(segment: Column) -> Column:
    """Words of a command without leading VAR=value words."""
    words = fields(segment)
    at = F.array_position(F.transform(words, lambda w: ~w.rlike("^[A-Za-z0-9_]+=")), F.lit(True)).cast("int")
    return F.when(at > 0, F.slice(words, F.greatest(at, F.lit(1)), F.size(words))).otherwise(_NONE())


def normalize_runner(words: Column) -> Column:
    """Peels ``npx`` and the like off, as often as they occur."""

    def peel(w: Column, _: Column) -> Column:
        head, second = base_command(_first(w)), F.coalesce(F.get(w, F.lit(1)), F.lit(""))
        manager = head.isin("pnpm", "yarn", "bun")
        return (
            F.when(F.size(w) < 2, w).when(head.isin(*RUNNERS), _rest(w)).when(~manager, w)
            .when((F.size(w) > 2) & (second == "run"), w).when((F.size(w) > 2) & second.isin("exec", "dlx"), _rest(w, 3))
            .when(base_command(second).isin(*KNOWN_TOOLS), _rest(w)).otherwise(w)
        )

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), words, peel)


def is_long_running(words: Column) -> Column:
    flag = F.exists(_rest(words), lambda w: F.lower(w).isin(*LONG_FLAGS))
    part = F.exists(
        _rest(words), lambda w: ~F.startswith(w, F.lit("-")) & F.exists(F.split(F.lower(w), "[:\\-._/]"), lambda x: x.isin(*LONG_RUNNING))
    )
    return flag | part


def is_interactive_docker(words: Column) -> Column:
    sub = F.get(F.filter(_rest(words), lambda w: ~F.startswith(w, F.lit("-"))), F.lit(0))
    named = base_command(_first(words)).isin("docker", "podman")
    return named & F.coalesce(sub == "run", F.lit(False)) & ~F.exists(_rest(words), lambda w: w == "--rm")


def redirects_all(command: Column) -> Column:
    return command.contains("&>") | command.contains(">&") | (command.contains(">") & command.contains("2>&1"))


#: Reasons of ``wrap_decision``.
REASONS = {
    "empty": "empty command", "nothing": "nothing to run", "own": "already handled", "redirected": "output goes to a file",
    "sink": "the pipeline selects its output", "long": "long-running or interactive", "docker": "docker run without --rm",
    "query": "a query: its output is the answer", "deferred": "deferred to another tool", "wrap": "handled here",
}


def wrap_decision(command: Column, deferred: Column | None = None, own_names: tuple[str, ...] = ("millrace",)) -> Column:
    """struct<wrap, reason>: whether the output of a command line should be compacted, and why."""
    line = F.coalesce(_trim(command), F.lit(""))
    segments = split_segments(line)
    words = lambda s: normalize_runner(split_words(s))

    def reason(s: Column) -> Column:
        w = words(s)
        return F.transform(
            F.array(w),  # names the peeled words once
            lambda w: F.when(F.size(w) == 0, F.lit(None).cast("string")).when(is_long_running(w), "long")
            .when(is_interactive_docker(w), "docker").when(is_query_segment(w), "query"),
        )

    reasons = F.filter(F.flatten(F.transform(segments, reason)), lambda x: x.isNotNull())
    key = (
        F.when(line == "", "empty").when(F.size(segments) == 0, "nothing")
        .when(base_command(_first(split_words(F.get(segments, F.lit(0))))).isin(*own_names), "own")
        .when(redirects_all(line), "redirected")
        .when((F.size(segments) > 1) & is_pipeline_sink(words(F.element_at(segments, -1))), "sink")
        .when(F.size(reasons) > 0, F.get(reasons, F.lit(0)))
        .when(F.coalesce(deferred, F.lit(False)) if deferred is not None else F.lit(False), "deferred").otherwise("wrap")
    )
    text = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return F.struct((key == "wrap").alias("wrap"), F.element_at(text, key).alias("reason"))


def decided(df: DataFrame, by: str = "command", limit: int = 100_000, **columns: Column) -> DataFrame:
    """``df`` with columns that depend on the column ``by`` alone: worked out once for each distinct value.

    Commands repeat by the million, and their rules are long expressions. At most ``limit`` distinct values are
    worked out by one job at once and sent to all tasks; more are joined by value. Calling this runs that job.
    """
    return _decided(df, by, limit, columns)[0]


def decided_values(df: DataFrame, by: str, name: str, column: Column, limit: int = 100_000) -> tuple[DataFrame, set]:
    """``decided`` for one column with few values, and the set of its values."""
    out, rows = _decided(df, by, limit, {name: column})
    return out, {r[name] for r in (rows if rows is not None else out.select(name).distinct().collect())}


def _decided(df: DataFrame, by: str, limit: int, columns: dict[str, Column]) -> tuple[DataFrame, list | None]:
    known = df.select(by).distinct()
    worked = lambda x: x.select(F.col(by).alias("_by"), *[c.alias(k) for k, c in columns.items()])
    few = worked(known.limit(limit + 1))
    rows = few.collect()
    if len(rows) <= limit:
        once = F.broadcast(df.sparkSession.createDataFrame(rows, few.schema))
    else:
        once, rows = worked(known), None
    return df.join(once, df[by].eqNullSafe(once["_by"]), "left").drop("_by"), rows


def deferred_to_other(calls: DataFrame, claims: DataFrame, call_id: str = "call_id", command: str = "command") -> DataFrame:
    """``calls`` with ``deferred``: whether every segment of a call is claimed. No segment: not deferred."""
    # By distinct command, so that the commonest one is no hot key.
    parts = calls.select(F.col(command).alias("_c")).distinct().select("_c", F.explode(split_segments(F.col("_c"))).alias("_segment"))
    known = claims.select(F.col("command").alias("_segment")).distinct().withColumn("_claimed", F.lit(True))
    done = parts.join(known, "_segment", "left").groupBy("_c").agg(F.bool_and(F.coalesce("_claimed", F.lit(False))).alias("deferred"))
    joined = calls.join(done, F.col(command) == F.col("_c"), "left").drop("_c")
    return joined.withColumn("deferred", F.coalesce("deferred", F.lit(False)))


def shell_quote(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def wrap_command(command: Column, runner: str = "millrace run --") -> Column:
    return F.concat(F.lit(f"{runner} bash -c "), shell_quote(command))


def command_key(command: Column) -> Column:
    """What runs are grouped by: one word, two for tools with subcommands, three for ``x run y``."""
    base = lambda w: base_command(w, (".exe", ".cmd", ".bat"))
    words = fields(command)
    at = F.array_position(F.transform(words, lambda w, i: base(w).isin(*SHELLS) & F.get(words, i + 2).isNotNull() & (F.get(words, i + 1) == "-c")), F.lit(True))
    script = F.regexp_replace(F.array_join(F.slice(words, (at + 2).cast("int"), F.size(words) + 1), " "), r"""^["']+|["']+\z""", "")
    w = F.when(at > 0, fields(script)).otherwise(words)
    three = (F.size(w) > 2) & F.get(w, F.lit(1)).isin("run", "exec")
    keep = F.when(~base(_first(w)).isin(*TWO_WORDS), 1).when(three, 3).otherwise(2)
    return F.when(F.size(w) < 1, F.lit("(empty)")).otherwise(F.array_join(F.slice(w, 1, keep), " "))


def rewrite_tool_call(calls: DataFrame, tool: str = "Bash", runner: str = "millrace run --", own_names: tuple[str, ...] = ("millrace",)) -> DataFrame:
    """call_id, reply: for calls whose command should be wrapped, their input with the command replaced and
    every other field as it was. Other tools, bad JSON and calls without a command give no row. Calling this
    decides the distinct commands (see ``decided``)."""
    name = F.get_json_object("payload", "$.tool_name")
    given = F.from_json(F.get_json_object("payload", "$.tool_input"), "map<string,variant>")
    command = F.get_json_object("payload", "$.tool_input.command")
    found = calls.select("call_id", name.alias("tool"), given.alias("given"), command.alias("command"))
    found = found.where(F.coalesce("tool", F.lit("")).isin("", tool) & F.col("given").isNotNull() & (F.coalesce("command", F.lit("")) != ""))
    found = decided(found, wrap=wrap_decision(F.col("command"), own_names=own_names)["wrap"]).where("wrap")
    wrapped = F.parse_json(F.to_json(F.array(wrap_command(F.col("command"), runner))))
    new = F.transform_values("given", lambda k, v: F.when(k == "command", F.variant_get(wrapped, "$[0]", "variant")).otherwise(v))
    reply = F.to_json(F.struct(F.struct(F.lit("PreToolUse").alias("hookEventName"), new.alias("updatedInput")).alias("hookSpecificOutput")))
    return found.select("call_id", reply.alias("reply"))
