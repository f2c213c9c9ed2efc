"""Source text as columns: normalisation, metrics, paths, truncation, type names."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifiers that normalisation keeps as they are.
RESERVED = [
    "async", "await", "break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do", "else", "enum", "export", "extends",
    "false", "finally", "for", "function", "if", "implements", "import", "in", "instanceof", "interface", "let", "new", "null", "of", "private",
    "protected", "public", "readonly", "return", "static", "super", "switch", "this", "throw", "true", "try", "typeof", "undefined", "var", "void",
    "while", "with", "yield", "abstract", "as", "asserts", "constructor", "declare", "get", "set", "infer", "is", "keyof", "module", "namespace",
    "require", "type", "satisfies", "using", "any", "boolean", "never", "number", "object", "string", "symbol", "unknown", "Array", "Object", "String",
    "Number", "Boolean", "Promise", "Map", "Set", "WeakMap", "WeakSet", "Date", "Error", "console", "JSON", "Math", "BigInt", "Symbol", "Proxy",
    "Reflect", "$STR", "$NUM",
]

# The length limits of shown and embedded text.
SHOWN_CODE, EMBEDDED_CODE = 500, 24000

# White space, the ends of lines, and the patterns of normalisation in the order in which they apply.
_SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_STEPS = [
    (re.compile(r"`[^`]*`"), "$STR"),
    (re.compile(r'"(?:[^"\\]|\\[^\n\r\u2028\u2029])*"'), "$STR"),
    (re.compile(r"'(?:[^'\\]|\\[^\n\r\u2028\u2029])*'"), "$STR"),
    (re.compile(r"/\*[\s\S]*?\*/"), ""),
    (re.compile(r"//[^\n\r\u2028\u2029]*"), ""),
]
_NUMBERS = [
    re.compile(r"\b0[xX][0-9a-fA-F_]+n?\b", re.A),
    re.compile(r"\b0[bB][01_]+n?\b", re.A),
    re.compile(r"\b0[oO][0-7_]+n?\b", re.A),
    re.compile(r"(?<![a-zA-Z_$])\b\d[\d_]*(\.\d[\d_]*)?([eE][+-]?\d[\d_]*)?n?\b", re.A),
]
_NAMES = re.compile(r"\b[a-zA-Z_$][a-zA-Z0-9_$]*\b", re.A)
_RUN = re.compile(f"{_SPACE}+", re.A)


def _strip(col: Column) -> Column:
    return F.regexp_replace(col, f"^{_SPACE}+|{_SPACE}+$", "")


def normalize(code: str | None) -> str:
    """Code without comments and layout, literals as placeholders, names as $VAR_k by first appearance.

    A boundary can't stand before "$", so the placeholders of literals are names
    too, behind their "$": literals of all kinds normalise alike.
    """
    if not code or not _RUN.sub("", code):
        return ""
    for pattern, by in _STEPS:
        code = pattern.sub(lambda m, by=by: by, code)
    code = _RUN.sub(" ", code).strip(" ")
    for pattern in _NUMBERS:
        code = pattern.sub(lambda m: "$NUM", code)
    seen: dict[str, str] = {}
    kept = frozenset(RESERVED)
    return _NAMES.sub(lambda m: m[0] if m[0] in kept else seen.setdefault(m[0], f"$VAR_{len(seen) + 1}"), code)


def normalized_code(code: Column) -> Column:
    """normalize() of each row, in Arrow batches.

    Numbering names by first appearance needs a table per text; as array functions
    it takes time with the square of the text's length.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(normalize, na_action=None)

    return run(code)


def collapse_whitespace(code: Column) -> Column:
    """Lines trimmed, empty ones dropped, joined by a blank, runs of white space collapsed: in the end, every run is one blank."""
    return F.trim(F.regexp_replace(code, f"{_SPACE}+", " "))


def hash_of(text: Column) -> Column:
    """SHA-256 in hex; '' of an empty or null text."""
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # of no bytes
    return F.coalesce(F.nullif(F.sha2(text, 256), F.lit(empty)), F.lit(""))


def code_metrics(code: Column) -> dict[str, Column]:
    """parameter, statement, depth, line and token counts of the code as it was written."""
    code = F.coalesce(code, F.lit(""))
    blank = F.length(_strip(code)) == 0
    groups = F.regexp_extract_all(code, F.lit(r"\([^)]*\)"), F.lit(0))
    inner = F.transform(groups, lambda g: F.substring(g, F.lit(2), F.length(g) - 2))
    sizes = F.transform(inner, lambda p: F.size(F.filter(F.split(p, ","), lambda x: F.length(_strip(x)) > 0)))
    parameters = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    marks = F.regexp_count(code, F.lit("[;{}]"))
    braces = F.regexp_extract_all(code, F.lit(r"([{}])"), F.lit(1))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a, b):
        now = F.when(b == "{", a["now"] + 1).otherwise(F.greatest(F.lit(0), a["now"] - 1))
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    depth = F.aggregate(braces, start, step, lambda a: a["most"])
    lines = F.size(F.filter(F.split(code, "\n"), lambda x: F.length(_strip(x)) > 0))
    tokens = F.size(F.filter(F.split(code, f"{_SPACE}+"), lambda x: F.length(x) > 0))
    # Half of the marks, rounded up at .5.
    named = {"parameterCount": parameters, "statementCount": F.floor((marks + 1) / 2), "controlFlowDepth": depth, "lineCount": lines, "tokenCount": tokens}
    return {k: F.when(blank, F.lit(0)).otherwise(v).cast("long") for k, v in named.items()}


def metric_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Weighted closeness of two sets of metrics, 0 to 1."""

    def close(name):
        return 1 - F.abs(a[name] - b[name]) / F.greatest(a[name], b[name], F.lit(1))

    return close("parameterCount") * 0.15 + close("statementCount") * 0.35 + close("controlFlowDepth") * 0.15 + close("lineCount") * 0.35


# ---------------------------------------------------------------- truncation and paths


def truncated(code: Column, most: int = SHOWN_CODE) -> Column:
    return F.when(F.length(code) > 0, F.substring(code, 1, most))


def head_and_tail(code: Column, most: int, marker: str = "\n\n... [truncated] ...\n\n") -> Column:
    half = most // 2
    short = F.concat(F.substring(code, 1, half), F.lit(marker), F.expr("''") if not half else F.right(code, F.lit(half)))
    return F.when(F.length(code) <= most, code).otherwise(short)


def short_path(path: Column, segments: int = 2) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - segments + 1), F.lit(segments)), "/")


def file_suffix_excluded(path: Column, patterns: list[str]) -> Column:
    """A leading * is dropped; what is left must end the path."""
    out = F.lit(False)
    for p in patterns:
        out = out | path.endswith(p.removeprefix("*"))
    return out


def skipped_file(path: Column, patterns: list[str]) -> Column:
    """Any pattern found in the path literally, or as a regular expression where it is one."""
    out = F.lit(False)
    for p in patterns:
        out = out | path.contains(p)
        try:
            re.compile(p)
        except re.error:
            continue
        out = out | path.rlike(p)
    return out


def is_ui_component(path: Column) -> Column:
    return path.rlike(r"[/\\](components[/\\]ui|ui[/\\]components)[/\\]") & path.rlike(r"\.(tsx|jsx|vue)$")


def is_package_export(path: Column) -> Column:
    return path.rlike(r"[/\\]packages[/\\][^/\\]+[/\\]")


def app_name(path: Column) -> Column:
    """Null outside apps and packages."""
    name = F.regexp_extract(path, r"[/\\](apps|packages)[/\\]([^/\\]+)[/\\]", 2)
    return F.when(F.length(name) > 0, name)


def common_root(paths: Column) -> Column:
    """Longest run of leading segments that an array of paths shares."""
    # Segment by segment, what the smallest and the largest path share is what all share.
    parts = F.transform(paths, lambda p: F.split(p, "/"))
    low, high = F.array_min(parts), F.array_max(parts)
    differ = F.array_position(F.zip_with(low, high, lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    root = F.array_join(F.slice(low, F.lit(1), F.when(differ > 0, differ - 1).otherwise(F.size(low)).cast("int")), "/")
    # A path that is null shares nothing.
    return F.when(F.exists(paths, lambda p: p.isNull()), F.when(F.get(paths, F.lit(0)).isNotNull(), F.lit(""))).otherwise(root)


def relative_to(path: Column, root: Column) -> Column:
    inside = path.startswith(F.concat(root, F.lit("/")))
    return F.when(inside, F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)


def clean_type(name: Column) -> Column:
    """Without import(...) prefix, generic arguments and trailing []."""
    name = F.regexp_replace(name, r"import\([^)]*\)\.", "")
    name = F.regexp_replace(name, r"<[\s\S]*>", "")
    return F.trim(F.regexp_replace(name, r"(\[\])+$", ""))


def embedding_text(name: Column, labels: Column, code: Column, most: int = EMBEDDED_CODE) -> Column:
    """Name and labels, a line break, and the first characters of the code; null without code."""
    return F.when(F.length(code) > 0, F.concat(F.concat_ws(" ", name, labels), F.lit("\n"), F.substring(code, 1, most)))


def whole_number(value, default: int, most: int | None = None) -> int:
    """What a caller gave, as a number: the default for no number and below zero, and no more than ``most``."""
    try:
        n = int(float(value))
    except (TypeError, ValueError, OverflowError):
        n = default
    n = default if n < 0 else n
    return n if most is None else min(n, most)
