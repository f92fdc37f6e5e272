"""Line patterns, written in RE2 syntax, and their translation to the engine's regular expressions."""

from __future__ import annotations

_WORD = "0-9A-Za-z_"
_EDGE = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"


def java(pattern: str) -> str:
    """RE2 -> Java: ASCII word borders, no vertical tab in white space, `$` only at the very end."""
    out, i, inside = ["(?d)"], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two = pattern[i : i + 2]
            out.append({
                r"\b": _EDGE, r"\s": "\\t\\n\\f\\r " if inside else "[\\t\\n\\f\\r ]", r"\S": "[^\\t\\n\\f\\r ]",
            }.get(two, two))
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
            out.append(c)
            if pattern[i + 1] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1] == "]":
                out.append("\\]")
                i += 1
        elif c == "]" and inside:
            inside = False
            out.append(c)
        elif inside and c in "[&":
            out.append("\\" + c)
        elif c == "$" and not inside:
            out.append("\\z")
        else:
            out.append(c)
        i += 1
    return "".join(out)


# These patterns decide which lines are kept and must be as they are.
ESCAPES = (
    "\x1b\\[[0-9;:?]*[ -/]*[@-~]"
    "|\x1b\\][^\x07\x1b]*(?:\x07|\x1b\\\\)"
    "|\x1b[PX^_][^\x1b]*\x1b\\\\"
    "|\x1b[@-Z\\\\-_]"
)
PROGRESS_BAR = r"^[\s\pS\pC]*[-\\|/*.oO°⠁-⣿◐◓◑◒▁-█░▒▓■□▪▫=#>·⋅]+[\s\pS\pC]*$"
PROGRESS_FIGURE = r"\b\d{1,3}(\.\d+)?%|\bETA[: ]|\b\d+(\.\d+)?\s?[kKmMgG]?i?[bB]\s*/\s*\d+(\.\d+)?\s?[kKmMgG]?i?[bB]\b"
FAILURE = (
    r"(?i)error(s)?\b|exception(s)?\b|failed\b|failure(s)?\b|panic(ked|king)?\b|\berr\b|ERR!|\bfail(s|ing)?\b"
    r"|\btraceback\b|\bfatal\b|\bassert\b|\bunhandled\b|\bsegfault\b|\bsegmentation fault\b|\bE\d{3,}\b"
    r"|\bMSB\d+\b|\bCS\d{4}\b|\bNETSDK\d+\b"
)
#: FAILURE for the engine: the same language, but a place is left at once unless one of the first letters stands there, and
#: word borders are single look-arounds (about six times as fast; tests compare both).
FAILURE_JAVA = (
    rf"(?i)(?=[efptausmcn])(?:(?:errors?|exceptions?|failed|failures?|panic(?:ked|king)?)(?![{_WORD}])|err!"
    rf"|(?<![{_WORD}])(?:err|fail(?:s|ing)?|traceback|fatal|assert|unhandled|segfault|segmentation fault|e\d{{3,}}|msb\d+|cs\d{{4}}|netsdk\d+)(?![{_WORD}]))"
)
URL_TOKEN = r"\S*://\S*"
STACK_FRAME = (
    r"^\s*at\s+\S"
    r'|^\s*File "[^"]+", line \d+'
    r"|^\s*from [\w./\\-]+:\d+"
    r"|^\s*#\d+\s+0x[0-9a-fA-F]+"
    r"|^\s*[\w./\\-]+\.(go|rs|py|js|ts|tsx|jsx|cs|java|rb|php|c|cc|cpp|h):\d+"
    r"|^\s*--- FAIL"
    r"|^\s*thread '.*' panicked"
)
BLOCK_START = (
    r"^\s*\d+\)\s"
    r"|^\s*●"
    r"|^\s*(FAIL|FAILED)\b"
    r"|^\s*--- FAIL:"
    r"|^\s*not ok \d+"
    r"|AssertionError"
    r"|^\s*[A-Za-z_][\w.]*Error:"
    r"|^\s*Error:"
    r"|^\s*(Traceback \(most recent call last\)|Unhandled exception)"
    r"|^\s*thread '.*' panicked"
    r"|^\s*panic:"
)
BLOCK_END = (
    r"^\s*\d+ (passing|failing|pending)\b"
    r"|^\s*(Test Suites|Tests|Snapshots|Time|Duration):"
    r"|^\s*Ran all test suites"
    r"|^\s*test result:"
    r"|^\s*(PASS|ok)\s+\S+\s"
    r"|^=+ .* =+$"
    r"|^\s*#\s+(tests|pass|fail)\s+\d+"
    r"|^\s*(Build succeeded|Build FAILED|Time Elapsed)\b"
)
DETAIL = (
    r"^\s*[-+](\s|$|[^-+>])"
    r"|^\s*[-+]{3}\s"
    r"|^\s*[{}\[\]]"
    r"|^\s*(expected|actual|received|want|got)\b"
    r"|^\s*[+-]\s*expected"
    r"|^\s*\|"
    r"|^\s*\^+"
    r"|^\s*~+$"
    r"|^\s*\d+\s*\|"
)
SELF_CONTAINED = r"(?i)^\s*\d+\s+(warning|error)\(s\)|\bwarn(ing)?\b.*\b[A-Z]+\d{3,}:|^\s*npm\s+warn\b"
LOG_NOISE = (
    r"(?i)^\s*\[?(info|warn|warning|debug|trace|verbose|silly|notice|log)\]?\s*[:|\]]"
    r"|^\s*deprecation warning\b"
    r"|^\s*\[deprecation\]"
    r"|^\s*(npm|pnpm|yarn)\s+(warn|info|http|timing|verb|verbose|silly)\b"
    r"|^\s*<[wie]>\s"
)
SHAPES = (
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?", "<ts>"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>"),
    (r"\b0x[0-9a-fA-F]+\b", "<hex>"),
    (r"(?i)\b(sha256:)?[0-9a-f]{7,}\b", "<hash>"),
    (r'"[^"]*"', '"<s>"'),
    (r"'[^']*'", "'<s>'"),
    (r"\d+(\.\d+)?", "<n>"),
)
FILE_LINE = r"[\w./\\-]+\.[A-Za-z]+:\d+(?::\d+)?"
INSTALL_DEPRECATED = r"(?i)^\s*npm\s+warn\s+deprecated\b|^\s*warning\b.*\bdeprecated\b|^\s*warn\s+deprecated\b"
INSTALL_NOISE = (
    r"(?i:^\s*npm\s+(timing|verb|verbose|silly|sill|info|http)\b|^\s*(idealTree|reify|reifyNode|audit)\b"
    r"|packages? (are|is) looking for funding|^\s*run `npm fund`|^\s*npm\s+notice\b"
    r"|New (major|minor|patch)? ?version of npm available|Changelog:\s*https://github.com/npm/cli"
    r"|^\s*To update run:\s*npm install -g npm)"
    r"|^\s*\[\d+/\d+\]\s+(Resolving|Fetching|Linking|Building)\b|^\s*success Saved lockfile\."
    r"|^\s*info (fsevents|There appears to be trouble)|^\s*(Progress:\s*resolved|Packages:|Downloading\s)"
)
INSTALL_SUMMARY = (
    r"(?i)^\s*(added|removed|changed|audited)\s+\d+\s+packages?|^\s*up to date\b"
    r"|^\s*\+?\d+\s+packages?\s+(added|installed)\b|\bfound \d+ vulnerabilit|^\s*\d+ vulnerabilit"
    r"|^\s*(Done|success Already up-to-date|success Saved \d+)\b|^\s*(Dependencies|devDependencies|Packages):\s*$"
)
DOTNET_RESTORED = r"^\s*Restored\s+.*\((in|took)\s"
DOTNET_BUILT = r"^\s*\S+\s+->\s+\S+\.(dll|exe|pdb)\s*$"
DOTNET_CHATTER = (
    r"^\s*(Determining projects to restore|Nothing to do\. None of the projects|All projects are up-to-date for restore"
    r"|Restore (complete|succeeded)|MSBuild version|Welcome to \.NET|----------|Build started|Using launch settings)\b"
    r"|^\s*Restored\s+\S+\s*$"
)
DOTNET_KEEP = (
    r"\b(warning|error)\s+[A-Z]+\d+:|^\s*(Build succeeded|Build FAILED|Time Elapsed)\b|^\s*\d+\s+(Warning|Error)\(s\)"
    r"|^\s*(Passed!|Failed!|Skipped!)\s|^\s*Test Run (Successful|Failed|Aborted)"
    r"|(?i:^\s*(Total tests|Passed|Failed|Skipped|Total time):)"
)
TEST_FAILURE = (
    r"^\s*(FAIL|✕|×|✗)\b|^\s*●|^\s*--- FAIL:|^(FAILED|ERROR)\b|^\s*\d+\)\s|^not ok \d+|^\s*(test result: FAILED|failures:)"
)
TEST_HEADER = r"^\s*(PASS|RUN|✓|✔|√)\b|^\s*(Test Suites|Tests|Snapshots|Time|Duration|Ran all test suites)\b|^\s*\d+ (passing|failing|pending)\b"
TEST_PASS = (
    r"^\s*(PASS|✓|✔|√)\b|^\s*[✓✔√]\s|^ok \d+|^\s*ok\s+\S+\s+[\d.]+s|^\s*---\s+PASS:|^\s*RUN\s+v[\d.]+"
    r"|^\s*\S+\s+\.+\s*(ok|PASSED)\s*$|^\s*(Determining|Collecting|collected)\s"
)
TEST_SUMMARY = (
    r"^\s*(Test Suites|Tests|Snapshots|Time|Duration|Start at):|^\s*Ran all test suites"
    r"|(?i:^\s*\d+ (passing|pending|failing)\b|^=+ .*(passed|failed|error).* =+$|^\s*test result:"
    r"|^\s*(Passed!|Failed!)\s+-\s+Failed:|^\s*Tests? (run|Run):|^\s*#\s+(tests|pass|fail|skip)\s+\d+|^\s*1\.\.\d+\s*$)"
)
TEST_FAILING = r"^\s*\d+ failing\b"
TAP_RESULT = r"^\s*(not )?ok \d+"
TEST_MARKER = (
    r"^\s*(PASS|FAIL)\s+\S+\.(test|spec)\.|^\s*Test Suites:|^\s*RUN\s+v[\d.]+|^\s*(Tests|Snapshots):\s+\d"
    r"|\bjest\b|\bvitest\b|\bmocha\b|^\s*\d+ (passing|failing|pending)\b|^ok \d+|^not ok \d+"
    r"|^#\s+(tests|pass|fail|skip)\s+\d+|^TAP version \d+"
)
STEP_LINE = r"^#(\d+)\s+(.*)$"
STEP_HEADER = r"^(\[[^\]]+\]|CACHED)\s"
STEP_PROGRESS = r"^sha256:[0-9a-f]+|^(transferring|extracting|resolve|pulling|download|sending)\b|^\.{3,}$"
STEP_DONE = r"^DONE\s"
STEP_ERROR = r"^(ERROR|CANCELED)\b"

#: The bar pattern for a backtracking engine: P are bar signs that are no symbols, Q those that are, R other
#: symbols; possessive, so linear in the line.
_A, _P, _Q = r"[\t\n\f\r \p{S}\p{C}]", r"[-\\/*.oO#·]", r"[|°⠁-⣿◐◓◑◒▁-█░▒▓■□▪▫=>⋅]"
_R = _A[:-1] + "&&[^" + _Q[1:] + "]"
PROGRESS_BAR_JAVA = rf"^(?:{_R}*+{_Q}{_A}*+|{_A}*+{_P}(?:{_Q}*+{_P})*+{_A}*+)\z"
