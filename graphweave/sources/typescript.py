"""TypeScript sources to graph rows, file by file, without a compiler.

A scanner blanks strings and comments, declarations are found by pattern and
bounded by matching brackets.  What only type inference knows (the type of a
local variable that a method is called on) stays unknown; such calls resolve by
name.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as T
from ..operators import resolve
from ..operators.graph import EDGE_WEIGHTS, PropertyGraph
from .files import plain_path

# Calls that make no edge: built-in functions, methods and classes.
BUILT_IN_FUNCTIONS = frozenset([
    "console", "setTimeout", "setInterval", "clearTimeout", "clearInterval", "parseInt", "parseFloat", "isNaN", "isFinite", "encodeURI", "decodeURI",
    "encodeURIComponent", "decodeURIComponent", "JSON", "Math", "Date", "Object", "Array", "String", "Number", "Boolean", "Symbol", "BigInt", "Promise",
    "require", "eval",
])
BUILT_IN_METHODS = frozenset([
    "push", "pop", "shift", "unshift", "slice", "splice", "concat", "join", "reverse", "sort", "indexOf", "lastIndexOf", "includes", "find", "findIndex",
    "filter", "map", "reduce", "reduceRight", "every", "some", "forEach", "flat", "flatMap", "fill", "entries", "keys", "values", "charAt", "charCodeAt",
    "substring", "substr", "split", "trim", "trimStart", "trimEnd", "toLowerCase", "toUpperCase", "replace", "replaceAll", "match", "search",
    "startsWith", "endsWith", "padStart", "padEnd", "repeat", "hasOwnProperty", "toString", "valueOf", "toJSON", "then", "catch", "finally", "log",
    "error", "warn", "info", "debug", "trace", "dir", "table", "bind", "call", "apply",
])
BUILT_IN_CLASSES = frozenset([
    "Array", "Object", "String", "Number", "Boolean", "Date", "RegExp", "Error", "TypeError", "RangeError", "SyntaxError", "ReferenceError", "Map",
    "Set", "WeakMap", "WeakSet", "Promise", "Proxy", "Reflect", "Symbol", "BigInt", "ArrayBuffer", "DataView", "Int8Array", "Uint8Array", "Int16Array",
    "Uint16Array", "Int32Array", "Uint32Array", "Float32Array", "Float64Array", "URL", "URLSearchParams", "TextEncoder", "TextDecoder", "Buffer",
    "EventEmitter",
])
# Nodes that stand in their parent's text by signature and id only.
SKELETONS = ["MethodDeclaration", "FunctionDeclaration", "PropertyDeclaration"]
#: Shorter bodies are not searched for calls.
LEAST_BODY = 15
_NOT_CALLS = frozenset([
    "if", "for", "while", "switch", "catch", "return", "function", "super", "typeof", "await", "new", "throw", "constructor", "of", "in", "do", "else",
])
_NAME = r"[A-Za-z_$][\w$]*"

_BRACKETS = {"(": re.compile(r"[()]"), "{": re.compile(r"[{}]"), "[": re.compile(r"[\[\]]")}
_TOKEN = re.compile(rf"=>|{_NAME}|\d[\w.]*|.", re.S)
_STOPS = re.compile(r"\s*(?:[{|&=\[<.?:]|extends\b|is\b|$)")
_MASKED = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?|`(?:\\.|[^`\\])*`?")
_ROUTE = "struct<method:string,path:string,controllerName:string,handler:string,authenticated:boolean>"
#: Columns of nodes, then those of edges and deferred edges.
_NODE_COLUMNS = {
    "id": "string", "projectId": "string", "name": "string", "coreType": "string", "labels": "array<string>", "filePath": "string", "startLine": "int", "endLine": "int", "sourceCode": "string", "isExported": "boolean",
    "visibility": "string", "isAsync": "boolean", "isStatic": "boolean", "parentClassName": "string", "typeAnnotation": "string", "decorators": "array<string>", "decoratorArgs": "map<string,array<string>>", "extendsName": "string",
    "constructorTypes": "array<string>", "injectTokens": "map<int,string>", "propertyTypes": "array<string>", "routes": f"array<{_ROUTE}>", "seq": "long",
}
_EDGE_COLUMNS = dict.fromkeys("edgeType src dst targetName targetType targetFilePath receiverExpression receiverType receiverPropertyName".split(), "string")
#: isLast: no later node of the file has this one's id.
_ALL = {"kind": "string"} | _NODE_COLUMNS | _EDGE_COLUMNS | {"isLast": "boolean"}
NODE_SCHEMA = ", ".join(f"{c} {t}" for c, t in _ALL.items())
# Labels of the core types.
LABELS = {
    "SourceFile": ["SourceFile", "TypeScript"], "ClassDeclaration": ["Class", "TypeScript"], "MethodDeclaration": ["Method", "TypeScript"], "PropertyDeclaration": ["Property", "TypeScript"],
    "ParameterDeclaration": ["Parameter", "TypeScript"], "ImportDeclaration": ["Import", "TypeScript"], "Decorator": ["Decorator"], "InterfaceDeclaration": ["Interface", "TypeScript"],
    "EnumDeclaration": ["Enum", "TypeScript"], "FunctionDeclaration": ["Function", "TypeScript"], "VariableDeclaration": ["Variable", "TypeScript"], "TypeAlias": ["TypeAlias", "TypeScript"],
    "ConstructorDeclaration": ["Constructor", "TypeScript"],
}


def blanked(code: str) -> str:
    """The code with strings and comments as blanks, line breaks kept, so that positions stay."""
    return _MASKED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)


def closing(text: str, at: int) -> int:
    """Position after the bracket that closes the one at ``at``; the end if none does."""
    opens, depth = text[at], 0
    for m in _BRACKETS[opens].finditer(text, at):
        depth += 1 if m[0] == opens else -1
        if depth == 0:
            return m.end()
    return len(text)


def closing_angle(text: str, at: int) -> int:
    """Position after the ">" that closes the "<" at ``at``; arrows don't count, brackets inside are stepped over."""
    i, depth = at, 0
    while i < len(text):
        ch = text[i]
        if ch in "([{":
            i = closing(text, i)
            continue
        if ch == "<":
            depth += 1
        elif ch == ">" and text[i - 1] != "=":
            depth -= 1
            if depth == 0:
                return i + 1
        elif ch == ";":
            return i
        i += 1
    return i


def pieces(text: str) -> list[str]:
    """Parts between commas outside brackets."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        if ch in "([{<":
            depth += 1
        elif ch in ")]}" or (ch == ">" and text[i - 1] != "="):
            depth -= 1
        elif ch == "," and depth <= 0:
            out.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*out, text[start:]] if p.strip()]


def bare_type(name: str) -> str:
    """A type's name without generic arguments and arrays."""
    return re.sub(r"(\[\])+$", "", re.sub(r"<[\s\S]*>", "", name)).strip()


@dataclass
class File:
    path: str
    code: str
    project: str
    every_variable: bool = False
    rows: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self.text = blanked(self.code)
        self.breaks = [m.start() for m in re.finditer("\n", self.code)]

    # ------------------------------------------------------------ rows

    def line(self, at: int) -> int:
        return bisect_left(self.breaks, at) + 1

    def node(self, core: str, name: str, start: int, end: int, parent: str | None = None, edge: str | None = None, **more) -> str:
        parts = [self.project, core, self.path, *([parent] if parent else []), name]
        own = f"{self.project}:{core}:{hashlib.sha256('::'.join(parts).encode()).hexdigest()[:16]}"
        if parent and core in SKELETONS and "{" in self.code[start:end]:
            outer = next(r for r in reversed(self.rows) if r["kind"] == "node" and r["id"] == parent)
            outer["sourceCode"] = outer["sourceCode"].replace(self.code[start:end], f"{self.code[start:end].split('{', 1)[0].strip()} {{ /* NodeID: {own} */ }}", 1)
        self.rows.append({"kind": "node", "id": own, "projectId": self.project, "name": name, "coreType": core, "labels": [*LABELS[core], "GraphNode"], "filePath": self.path, "startLine": self.line(start), "endLine": self.line(max(start, end - 1)), "sourceCode": self.code[start:end], "seq": len(self.rows)} | more)
        if parent and edge:
            self.rows.append({"kind": "edge", "projectId": self.project, "edgeType": edge, "src": parent, "dst": own, "seq": len(self.rows)})
        return own

    def later(self, edge: str, src: str, name: str, target: str, **more):
        self.rows.append({"kind": "deferred", "projectId": self.project, "edgeType": edge, "src": src, "targetName": name, "targetType": target, "seq": len(self.rows)} | more)

    # ------------------------------------------------------------ declarations

    def parse(self) -> list[dict]:
        root = self.node("SourceFile", self.path.rsplit("/", 1)[-1], 0, len(self.code))
        self.imports(root)
        flat = self.top_level()
        head = rf"(?m)^(?P<deco>(?:[ \t]*@{_NAME}(?:\.{_NAME})*(?:\([^;{{}}]*?\))?\s*)*)[ \t]*(?P<mods>(?:(?:export|default|declare|abstract|async)\s+)*)"
        for m in re.finditer(head + rf"(?P<what>class|interface|enum|function\*?|type|const|let|var)\s+(?P<name>{_NAME})", flat):
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            name, what, exported = m["name"], m["what"], "export" in m["mods"].split()
            more = {"isExported": exported} | self.named(self.decorators(m.start("deco"), m.end("deco")))
            if what in ("class", "interface", "enum"):
                brace = self.heading_end(m.end())
                if brace < 0:
                    continue
                end = closing(self.text, brace)
                heading = self.text[m.end() : brace]
                if what == "class":
                    self.klass(root, name, start, brace, end, heading, more)
                elif what == "interface":
                    own = self.node("InterfaceDeclaration", name, start, end, root, "CONTAINS", **more)
                    if x := re.search(r"\bextends\s+(.+)", heading, re.S):
                        for p in pieces(x[1]):
                            self.later("EXTENDS", own, bare_type(p), "InterfaceDeclaration")
                else:
                    self.node("EnumDeclaration", name, start, end, root, "CONTAINS", **more)
            elif what.startswith("function"):
                paren = self.after_generics(m.end())
                if self.text[paren : paren + 1] != "(":
                    continue
                after = closing(self.text, paren)
                brace, end = self.body(after, len(self.text))
                own = self.node("FunctionDeclaration", name, start, end, root, "CONTAINS", isAsync="async" in m["mods"].split(), **more)
                self.parameters(own, paren, after)
                self.calls(own, brace, end, {})
            elif what == "type":
                end = self.statement_end(m.end())
                self.node("TypeAlias", name, start, end, root, "CONTAINS", **more)
            elif exported or self.every_variable:
                end = self.statement_end(m.end())
                kind = re.match(r"\s*:\s*([^=;]+)", self.text[m.end() : end])
                # A variable's own default wins over what its statement says: it never counts as exported.
                self.node("VariableDeclaration", name, start, end, root, "CONTAINS", isExported=False, typeAnnotation=kind[1].strip() if kind else None, routes=self.route_list(m.end(), end))
        return self.rows

    def top_level(self) -> str:
        """The blanked text with everything inside braces and parentheses as blanks, but for decorators' arguments."""
        out, depth = list(self.text), 0
        for i, ch in enumerate(self.text):
            if ch in ")}":
                depth = max(0, depth - 1)
            if depth and ch != "\n":
                out[i] = " "
            if ch in "({":
                depth += 1
        return "".join(out)

    def after_generics(self, at: int) -> int:
        """The next position that is no blank, behind type parameters if there are any."""
        while at < len(self.text) and self.text[at].isspace():
            at += 1
        if self.text[at : at + 1] == "<":
            at = closing_angle(self.text, at)
            while at < len(self.text) and self.text[at].isspace():
                at += 1
        return at

    def heading_end(self, at: int) -> int:
        """Where the braces of a class, interface or enum open; -1 if they don't."""
        while at < len(self.text):
            ch = self.text[at]
            if ch == "{":
                return at
            if ch in ";}":
                return -1
            at = closing_angle(self.text, at) if ch == "<" else closing(self.text, at) if ch in "([" else at + 1
        return -1

    def body(self, at: int, stop: int) -> tuple[int, int]:
        """Of what follows a parameter list: where its body opens (-1 without one) and where the declaration ends.

        A result type is stepped over.  A brace opens the body unless a type is due
        there, behind a colon or an operator of types.  Without body a declaration
        ends behind its semicolon, or with the line if nothing goes on.
        """
        due, typed = False, False
        while at < stop:
            if self.text[at].isspace():
                quote = self.code[at] if self.code[at] in "'\"`" else ""
                if quote and due:  # a literal type, blanked
                    at += len(re.compile(rf"{quote}(?:\\.|[^{quote}\\])*{quote}?").match(self.code, at)[0])
                    due = False
                elif self.code.startswith(("//", "/*"), at):
                    at = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)").match(self.code, at).end()
                elif self.text[at] == "\n" and not due and not _STOPS.match(self.text, at):
                    return -1, at
                else:
                    at += 1
                continue
            m = _TOKEN.match(self.text, at)
            if m[0] == "{":
                end = closing(self.text, at)
                if not due:
                    return at, end
                at, due = end, False
            elif m[0] in "([":
                at, due = closing(self.text, at), False
            elif m[0] == "<":
                at, due = closing_angle(self.text, at), False
            elif m[0] == ";":
                return -1, at + 1
            elif m[0] in ")}],":
                return -1, at
            else:
                typed = typed or m[0] == ":"
                due = typed and m[0] in (":", "=>", "|", "&", "?", "extends", "is", "keyof", "typeof", "readonly", "infer", "unique", "asserts", "new", "abstract")
                at = m.end()
        return -1, at

    def statement_end(self, at: int) -> int:
        depth = 0
        for i in range(at, len(self.text)):
            ch = self.text[i]
            if ch in "([{":
                depth += 1
            elif ch in ")]}":
                depth -= 1
            elif depth <= 0 and (ch == ";" or (ch == "\n" and re.match(r"\s*(export|import|const|let|var|function|class|interface|type|enum|@|$)", self.text[i:]))):
                return i + 1
        return len(self.text)

    def decorators(self, a: int, b: int) -> list[tuple[str, list[str]]]:
        """(name, arguments) of the decorators between two positions."""
        out, at = [], a
        while m := re.compile(rf"@({_NAME}(?:\.{_NAME})*)\s*").search(self.text, at, b):
            at, args = m.end(), []
            if at < len(self.text) and self.text[at] == "(":
                end = closing(self.text, at)
                args, at = pieces(self.code[at + 1 : end - 1]), end
            out.append((m[1], args))
        return out

    @staticmethod
    def named(decorators: list[tuple[str, list[str]]]) -> dict:
        return {"decorators": [d for d, _ in decorators], "decoratorArgs": dict(reversed(decorators))}

    def imports(self, root: str):
        for m in re.finditer(r"(?m)^\s*import\b[^;'\"]*['\"]([^'\"\n]+)['\"]\s*;?", self.code):
            spec = m[1]
            self.node("ImportDeclaration", spec, m.start() + len(m[0]) - len(m[0].lstrip()), m.end(), root, "CONTAINS")
            if spec.startswith((".", "@")):
                self.later("IMPORTS", root, spec, "SourceFile", targetFilePath=self.beside(spec) if spec.startswith(".") else spec)

    def beside(self, spec: str) -> str:
        parts = self.path.split("/")[:-1]
        for p in spec.split("/"):
            if p == "..":
                parts = parts[:-1]
            elif p != ".":
                parts.append(p)
        return "/".join(parts)

    def klass(self, root, name, start, brace, end, heading, more):
        base = re.search(rf"\bextends\s+({_NAME}(?:\.{_NAME})*)", heading)
        inside = range(brace + 1, end - 1)
        members = list(self.members(inside.start, inside.stop))
        ctor = next((x for x in members if x[0] == "constructor"), None)
        types = self.parameter_types(ctor[2], ctor[3]) if ctor else []
        held = [t for x in members if x[0] == "property" for t in re.findall(rf"^\s*[?!]?\s*:\s*({_NAME}[^=;\n]*?)\s*(?:[=;\n]|$)|=\s*new\s+({_NAME})", self.text[x[2] : x[3]])]
        held = [a or b for a, b in held] + [t for _, t in types]
        tokens = self.inject_tokens(ctor[2]) if ctor else {}
        own = self.node("ClassDeclaration", name, start, end, root, "CONTAINS", extendsName=base and base[1], constructorTypes=[t for _, t in types], propertyTypes=held, injectTokens=tokens, **more)
        for d in more["decorators"]:
            self.node("Decorator", d, start, start + 1, own, "DECORATED_WITH")
        if base:
            self.later("EXTENDS", own, bare_type(base[1]), "ClassDeclaration")
        if x := re.search(r"\bimplements\s+(.+)", heading, re.S):
            for p in pieces(x[1]):
                self.later("IMPLEMENTS", own, bare_type(p), "InterfaceDeclaration")
        fields = dict(types)
        fields |= {x[1]: bare_type(t[1]) for x in members if x[0] == "property" and (t := re.match(rf"\s*[?!]?\s*:\s*({_NAME}[\w$.<>\[\]]*)", self.text[x[2] : x[3]]))}
        for what, label, a, b, s, mods, decos in members:
            visibility = next((v for v in ("private", "protected", "public") if v in mods), "public")
            extra = {"visibility": visibility, "parentClassName": name, "isStatic": "static" in mods} | self.named(decos)
            if what == "property":
                m = re.match(r"\s*[?!]?\s*:\s*([^=;]+)", self.text[a:b])
                it = self.node("PropertyDeclaration", label, s, b, own, "HAS_MEMBER", typeAnnotation=m and m[1].strip(), **extra)
            else:
                after = closing(self.text, a)
                body = self.body(after, b)[0]
                core = "ConstructorDeclaration" if what == "constructor" else "MethodDeclaration"
                it = self.node(core, label, s, b, own, "HAS_MEMBER", isAsync="async" in mods, **extra)
                self.parameters(it, a, after)
                self.calls(it, body, b, fields)
            for d, _ in decos:
                self.node("Decorator", d, s, s + 1, it, "DECORATED_WITH")

    def members(self, a: int, b: int) -> Iterator[tuple]:
        """(what, name, from, to, start, modifiers, decorators) of the members of a class body."""
        word = re.compile(rf"\s*(?P<deco>(?:@{_NAME}(?:\.{_NAME})*\s*)?)(?P<mods>(?:(?:public|private|protected|static|readonly|abstract|async|override|declare|get|set)\s+)*)(?P<name>\*?\s*#?{_NAME})?")
        at = a
        while at < b:
            decos, first = [], None
            while m := re.match(rf"\s*@({_NAME}(?:\.{_NAME})*)", self.text[at:b]):
                first = at + len(m[0]) - len(m[0].lstrip()) if first is None else first
                start, at = at, at + m.end()
                if at < b and self.text[at] == "(":
                    at = closing(self.text, at)
                decos += self.decorators(start, at)[:1]
            m = word.match(self.text, at, b)
            if not m or not m["name"]:
                skip = re.compile(r"[\s;]+|.").match(self.text, at, b)
                at = skip.end() if skip else b
                if skip and skip[0] in "([{":
                    at = closing(self.text, at - 1)
                continue
            name, mods = m["name"].lstrip("* "), m["mods"].split()
            start = first if first is not None else m.start() + len(m[0]) - len(m[0].lstrip())
            i = m.end()
            mark = re.compile(r"\s*[?!]?\s*").match(self.text, i, b)
            i2 = self.after_generics(mark.end())
            if i2 < b and self.text[i2] == "(":
                after = closing(self.text, i2)
                end = self.body(after, b)[1]
                yield ("constructor" if name == "constructor" else "method", name, i2, min(end, b), start, mods, decos)
                at = end
            else:
                end = min(self.member_end(i, b), b)
                yield ("property", name, i, end, start, mods, decos)
                at = max(end, i + 1)

    def member_end(self, at: int, b: int) -> int:
        depth = 0
        for i in range(at, b):
            ch = self.text[i]
            if ch in "([{":
                depth += 1
            elif ch in ")]}":
                depth -= 1
            elif depth <= 0 and (ch == ";" or (ch == "\n" and re.match(r"\s*([@#\w]|$)", self.text[i:b]))):
                return i + 1
        return b

    def parameter_types(self, paren: int, end: int) -> list[tuple[str, str]]:
        out = []
        for p in pieces(self.text[paren + 1 : closing(self.text, paren) - 1]):
            p = re.sub(rf"@{_NAME}(\([^)]*\))?\s*", "", p)
            m = re.match(rf"(?:(?:public|private|protected|readonly)\s+)*({_NAME})\s*\??\s*:\s*({_NAME}(?:\.{_NAME})*)", p)
            if m:
                out.append((m[1], bare_type(m[2])))
        return out

    def inject_tokens(self, paren: int) -> dict[int, str]:
        """Token of each constructor parameter with @Inject, by position."""
        out = {}
        for i, p in enumerate(pieces(self.code[paren + 1 : closing(self.text, paren) - 1])):
            if m := re.search(r"@Inject\(\s*([^)]*?)\s*\)", p):
                out[i] = m[1].strip("'\"`")
        return out

    def route_list(self, a: int, b: int) -> list[dict] | None:
        """Objects with method and path in the array that a variable starts with."""
        at = self.text.find("[", self.text.find("=", a, b) + 1, b) if "=" in self.text[a:b] else -1
        if at < 0:
            return None
        out = []
        for part in pieces(self.code[at + 1 : closing(self.text, at) - 1]):
            if part.startswith("{"):
                found = dict(m.groups() for x in pieces(part[1:-1]) if (m := re.match(rf"\s*['\"]?({_NAME})['\"]?\s*:\s*([\s\S]+)", x)))
                plain = lambda k: re.sub("['\"]", "", found[k]) if k in found else None
                if found.get("method") and found.get("path"):
                    out.append({"method": plain("method"), "path": plain("path"), "controllerName": found.get("controller"), "handler": plain("handler"), "authenticated": found["authenticated"] == "true" if "authenticated" in found else None})
        return out

    def parameters(self, own: str, paren: int, end: int):
        at = paren + 1
        for p in pieces(self.text[paren + 1 : end - 1]):
            start = self.text.find(p, at)
            at = start + len(p)
            m = re.match(rf"(?:@{_NAME}(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|readonly)\s+)*(?:\.\.\.)?({_NAME})\s*\??\s*(?::\s*([^=]+))?", p)
            if m:
                self.node("ParameterDeclaration", m[1], start, at, own, "HAS_PARAMETER", typeAnnotation=m[2] and m[2].strip())

    def calls(self, own: str, a: int, b: int, fields: dict[str, str]):
        """Calls in a body, one for each target and receiver type."""
        if a < 0 or len(self.code[a:b].strip()) < LEAST_BODY:
            return
        seen = set()
        for m in re.finditer(rf"(?<![\w$.])(?P<new>new\s+)?(?P<path>{_NAME}(?:\s*\??\.\s*{_NAME})*)\s*(?:<[^<>()]*>)?\(", self.text[a:b]):
            parts = re.split(r"\s*\??\.\s*", m["path"])
            name, receiver = parts[-1], parts[:-1]
            if m["new"]:
                target, kind, prop, holder = parts[0], None, None, None
                if target in BUILT_IN_CLASSES:
                    continue
                what = "ConstructorDeclaration"
            elif not receiver:
                target, kind, prop, holder = name, None, None, None
                if name in BUILT_IN_FUNCTIONS or name in _NOT_CALLS:
                    continue
                what = "FunctionDeclaration"
            else:
                if name in BUILT_IN_METHODS or receiver[0] in BUILT_IN_FUNCTIONS:
                    continue
                target, what, holder = name, "MethodDeclaration", ".".join(receiver)
                prop = receiver[1] if receiver[0] == "this" and len(receiver) == 2 else None
                kind = fields.get(prop) if prop else None
            if (target, kind) not in seen:
                seen.add((target, kind))
                self.later("CALLS", own, target, what, receiverExpression=holder, receiverType=kind, receiverPropertyName=prop, startLine=self.line(a + m.start()))


def parse_files(files: DataFrame, project: str) -> DataFrame:
    """Rows of nodes, edges and deferred edges (column kind) of read files, each parsed on its own.

    Files are dealt by path to some tasks a core first: a table of files may come in
    one partition, and parsing takes far longer than moving it.
    """
    types = {f.name: f.type for f in to_arrow_schema(StructType.fromDDL(NODE_SCHEMA))}
    maps = [c for c, t in types.items() if pa.types.is_map(t)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, last = [], batch.num_rows - 1
            for i in range(batch.num_rows):
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                found = File(path, bytes(content).decode("utf-8", "replace"), project).parse()
                for r in {r["id"]: r for r in found if r["kind"] == "node"}.values():
                    r["isLast"] = True
                rows += found
                if i == last or len(rows) >= 8192:
                    for r in rows:
                        r.update({c: list(r[c].items()) for c in maps if r.get(c) is not None})
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in types.items()], names=list(types))
                    rows = []

    spark = files.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.select(plain_path(F.col("path")).alias("path"), "content").repartition(tasks, "path").mapInArrow(run, NODE_SCHEMA)


def build_graph(files: DataFrame, project: str, existing: PropertyGraph | None = None) -> PropertyGraph:
    """The graph of source files: nodes, edges of containment, and deferred edges that resolve."""
    from ..storage import cut, unsized

    rows = unsized(cut(parse_files(files, project)))  # a file's rows take many times the bytes of what it was made of
    raw = rows.where("kind = 'node'").select(*_NODE_COLUMNS, "isLast")
    # An id is made of its file's path: only where a path comes twice can files share ids.
    nodes = raw.where("isLast")
    if not rows.where("coreType = 'SourceFile'").groupBy("id").count().where("count > 1").isEmpty():
        rest = [c for c in raw.columns if c != "id"]
        nodes = nodes.groupBy("id").agg(F.max_by(F.struct(*rest), "seq").alias("x")).select("id", "x.*")
    nodes = nodes.drop("isLast")
    hashed = F.col("coreType").isin("MethodDeclaration", "FunctionDeclaration", "ConstructorDeclaration")
    nodes = nodes.withColumn("semanticType", F.lit(None).cast("string")).withColumn("normalizedHash", F.when(hashed, T.hash_of(T.normalized_code(F.col("sourceCode")))))
    plain = resolve.core_edges(rows.where("kind = 'edge'").select(F.col("edgeType").alias("type"), "src", "dst").distinct(), EDGE_WEIGHTS)
    deferred = rows.where("kind = 'deferred'").withColumn("deferred_id", F.sha2(F.concat_ws("|", "src", "edgeType", "targetName", "targetType", F.col("seq").cast("string")), 256))
    sought = ["id", "name", "coreType", "filePath", "parentClassName", "seq"]
    known = nodes.select(sought)
    known = cut(known if existing is None else known.unionByName(existing.nodes.select(*[c for c in sought if c in existing.nodes.columns]), allowMissingColumns=True))
    named = deferred.where("edgeType != 'CALLS'")
    found = resolve.resolve_names(named, known)
    linked = named.join(found.select("deferred_id", F.col("id").alias("dst_id")), "deferred_id").select(F.col("edgeType").alias("type"), "src", F.col("dst_id").alias("dst")).distinct()
    called = deferred.where("edgeType = 'CALLS'").drop("dst").withColumnRenamed("src", "sourceNodeId").withColumnRenamed("startLine", "lineNumber")
    calls = resolve.call_edges(called, resolve.resolve_calls(called, known)).dropDuplicates(["edge_id"])
    edges = plain.unionByName(resolve.core_edges(linked, EDGE_WEIGHTS)).unionByName(calls, allowMissingColumns=True)
    return PropertyGraph(nodes, edges.withColumn("projectId", F.lit(project)))
