"""Facts from source text: definitions, imports, calls, heritage and scopes, one table for all languages.

Python is read with its own parser. Brace languages and Ruby are read by a tokenizer that blanks strings and comments
and keeps a stack of blocks: it finds declarations by patterns, so it is near, not exact, for them.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .files import script_blocks

FACTS = "filePath string, fact string, id string, name string, label string, scope string, parent string, startLine int, endLine int, target string, form string, receiver string, arity int, required int, count int, type string, seq int"
_COLUMNS = [x.strip().split(" ")[0] for x in FACTS.split(",")]


class _Out:
    def __init__(self, path: str):
        self.path, self.rows = path, []

    def add(self, fact: str, **values) -> None:
        self.rows.append({"filePath": self.path, "fact": fact, "seq": len(self.rows), **values})

    def definition(self, label: str, qualified: str, name: str, scope: str, start: int, end: int, **values) -> str:
        key = f"{label}:{self.path}:{qualified}"
        self.add("definition", id=key, name=name, label=label, scope=scope, startLine=start, endLine=end, **values)
        return key

    def scope(self, key: str, parent: str | None, kind: str, start: int, end: int) -> None:
        self.add("scope", id=key, parent=parent, label=kind, startLine=start, endLine=end)


class _Python(ast.NodeVisitor):
    def __init__(self, path: str, text: str):
        self.out, self.stack = _Out(path), []
        tree = ast.parse(text)
        self.called = {n.func for n in ast.walk(tree) if isinstance(n, ast.Call)}
        self.module = f"scope:{path}"
        self.out.scope(self.module, None, "Module", 1, text.count("\n") + 1)
        self.stack.append((self.module, "", ""))
        self.generic_visit(tree)

    def _enter(self, node, label: str, **values) -> None:
        scope, prefix, _ = self.stack[-1]
        qualified = f"{prefix}.{node.name}" if prefix else node.name
        key = self.out.definition(label, qualified, node.name, scope, node.lineno, node.end_lineno, **values)
        own = f"scope:{self.out.path}:{qualified}:{node.lineno}"
        self.out.scope(own, scope, "Class" if label == "Class" else "Function", node.lineno, node.end_lineno)
        if self.stack[-1][2].startswith("Class:"):
            self.out.add("member", id=key, name=node.name, label=label, parent=self.stack[-1][2])
        if label == "Class":
            for base in node.bases:
                self.out.add("heritage", id=key, name=ast.unparse(base).split("[")[0].split(".")[-1], scope=scope, type="EXTENDS", startLine=node.lineno)
        self.out.add("owned", id=key, scope=own, label=label)
        self.stack.append((own, qualified, key))
        self.generic_visit(node)
        self.stack.pop()

    def visit_ClassDef(self, node):
        self._enter(node, "Class")

    def visit_FunctionDef(self, node):
        a = node.args
        named = [x for x in a.posonlyargs + a.args]
        method = self.stack[-1][2].startswith("Class:")
        skip = int(method and bool(named) and named[0].arg in ("self", "cls"))
        n = len(named) - skip
        open_ended = a.vararg is not None or a.kwarg is not None
        returns = ast.unparse(node.returns) if node.returns else None
        self._enter(node, "Method" if method else "Function", required=n - len(a.defaults), count=None if open_ended else n + len(a.kwonlyargs), type=returns)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, node):
        for x in node.names:
            self.out.add("import", name=x.asname or x.name.split(".")[0], scope=self.stack[-1][0], target=x.name.replace(".", "/"), form="namespace", startLine=node.lineno)

    def visit_ImportFrom(self, node):
        base = "../" * max(node.level - 1, 0) if node.level > 1 else "./" if node.level else ""
        for x in node.names:
            self.out.add("import", name=x.asname or x.name, scope=self.stack[-1][0], target=base + (node.module or "").replace(".", "/"), parent=x.name, form="wildcard" if x.name == "*" else "named", startLine=node.lineno)

    def visit_Call(self, node):
        f = node.func
        if isinstance(f, (ast.Name, ast.Attribute)):
            name = f.id if isinstance(f, ast.Name) else f.attr
            receiver = "" if isinstance(f, ast.Name) else ast.unparse(f.value)
            open_ended = any(isinstance(x, ast.Starred) for x in node.args) or any(k.arg is None for k in node.keywords)
            form = "member" if isinstance(f, ast.Attribute) else "constructor" if name[:1].isupper() else "free"
            self.out.add("call", name=name, scope=self.stack[-1][0], form=form, receiver=receiver, arity=None if open_ended else len(node.args) + len(node.keywords), startLine=node.lineno)
        self.generic_visit(node)

    def visit_Assign(self, node):
        for t in node.targets:
            if isinstance(t, ast.Name) and len(self.stack) == 1:
                self.out.definition("Variable", t.id, t.id, self.module, node.lineno, node.end_lineno)
        self.generic_visit(node)

    def visit_AnnAssign(self, node):
        if isinstance(node.target, ast.Name):
            scope, prefix, owner = self.stack[-1]
            label = "Property" if owner.startswith("Class:") else "Variable"
            if label == "Property" or len(self.stack) == 1:
                key = self.out.definition(label, f"{prefix}.{node.target.id}" if prefix else node.target.id, node.target.id, scope, node.lineno, node.end_lineno, type=ast.unparse(node.annotation))
                if label == "Property":
                    self.out.add("member", id=key, name=node.target.id, label=label, parent=owner)
            self.out.add("annotation", name=node.target.id, scope=scope, type=ast.unparse(node.annotation), startLine=node.lineno)
        self.generic_visit(node)

    def visit_arg(self, node):
        if node.annotation is not None:
            self.out.add("annotation", name=node.arg, scope=self.stack[-1][0], type=ast.unparse(node.annotation), startLine=node.lineno)
        self.generic_visit(node)

    def visit_Attribute(self, node):
        if isinstance(node.value, (ast.Name, ast.Attribute)) and node not in self.called:
            self.out.add("access", name=node.attr, scope=self.stack[-1][0], receiver=ast.unparse(node.value), form="read" if isinstance(node.ctx, ast.Load) else "write", startLine=node.lineno)
        self.generic_visit(node)


_STRINGS = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
_HASH = re.compile(r"""\#[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", re.S)
_TYPES = re.compile(r"\b(class|interface|struct|trait|enum|record|object|extension|protocol|impl|module|namespace|mixin)\s+(?:<[^>{]*>\s*)?([A-Za-z_]\w*)([^{;\n]*(?:\n\s*[^{;\n]*)?)?")
_GO_TYPES = re.compile(r"\btype\s+([A-Za-z_]\w*)\s+(struct|interface)\b")
_LABELS = {"class": "Class", "interface": "Interface", "struct": "Struct", "trait": "Trait", "enum": "Enum", "record": "Record", "object": "Class", "extension": "Class", "protocol": "Interface", "impl": "Impl", "module": "Module", "namespace": "Namespace", "mixin": "Trait"}
_FUNCTION = re.compile(r"\b(?:function\s*\*?|func|fn|fun|def|sub)\s+(?:\((?P<recv>[^)]*)\)\s*)?(?P<name>(?:[A-Za-z_]\w*\.)?[A-Za-z_]\w*[?!]?)\s*(?:<[^>(]*>)?\s*\((?P<args>[^)]*)\)")
_TYPED = re.compile(r"(?:^|[;{}\n])[ \t]*(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async|inline|constexpr|extern|const|unsigned|readonly|synchronized|native|default|sealed|partial|get|set)\s+)*(?P<type>[A-Za-z_][\w:<>,\[\].*&? ]*?[\s*&])?(?P<name>~?[A-Za-z_][\w:]*)\s*\((?P<args>[^(){};]*)\)\s*(?:const|override|noexcept|throws\s+[\w.,\s]+|:\s*[\w<>\[\]|.\s]+|async)?\s*\{")
_ARROW = re.compile(r"\b(?:const|let|var)\s+(?P<name>[A-Za-z_]\w*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\((?P<args>[^)]*)\)|[A-Za-z_]\w*)\s*(?::[^=\n]+)?=>")
_CALL = re.compile(r"(?P<new>\bnew\s+)?(?:(?P<recv>[A-Za-z_$][\w$]*(?:(?:\.|->|::|\?\.)[A-Za-z_$][\w$]*)*)(?:\.|->|::|\?\.))?(?P<name>[A-Za-z_$][\w$]*)\s*\(")
_ACCESS = re.compile(r"(?<![\w$.])(?P<recv>this|self|\$this)(?:\.|->)(?P<name>[A-Za-z_$][\w$]*)(?!\s*\()(?![\w$])")
_FIELD = re.compile(r"^[ \t]*(?:(?:public|private|protected|internal|static|final|readonly|declare|override)\s+)*(?P<name>[A-Za-z_$][\w$]*)[?!]?\s*:\s*(?P<type>[\w<>\[\]|., ]+?)\s*(?:=[^;\n]*)?;[ \t]*$", re.M)
_KEYWORDS = set("if for while switch catch return function func fn fun def class else do try throw new await yield sizeof typeof match when using lock foreach elseif unless until case super this constructor".split())
_IMPORTS = [
    ("named", re.compile(r"""^\s*import\s+(?:type\s+)?(?P<names>[^'"\n;]*?)\s*from\s*['"](?P<target>[^'"]+)['"]""", re.M)),
    ("named", re.compile(r"""^\s*(?:import|require_relative|require|include|include_once|require_once|export\s+\*\s+from)\s*\(?\s*['"](?P<target>[^'"\n]+)['"]""", re.M)),
    ("named", re.compile(r"""^\s*#\s*include\s*[<"](?P<target>[^>"\n]+)[>"]""", re.M)),
    ("named", re.compile(r"""^\s*(?:import|using|use)\s+(?:static\s+)?(?P<target>[\w.:\\]+(?:\.\*)?)\s*(?:as\s+(?P<alias>\w+))?\s*;?\s*$""", re.M)),
    ("named", re.compile(r"""^\s*(?:[\w.]+\s+)?"(?P<target>[\w.\-/]+/[\w.\-/]+)"\s*$""", re.M)),
]


def _arity(args: str | None) -> int | None:
    if args is None or "..." in args or "*" in args and "**" in args:
        return None
    args = re.sub(r"<[^<>]*>|\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}", "", args).strip()
    return 0 if not args or args == "void" else args.count(",") + 1


def _generic(path: str, text: str, lang: str, shift: int = 0) -> list[dict]:
    out = _Out(path)
    hidden = _HASH if lang in ("ruby",) else _STRINGS
    code = hidden.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    line = lambda at: bisect_right(starts, at) + shift
    last = line(len(text))
    close = _closings(code, lang)
    module = f"scope:{path}"
    out.scope(module, None, "Module", 1, last)
    blocks: list[tuple[int, int, str, str, str]] = []  # start, end, kind, name, id
    for m in _TYPES.finditer(code):
        _block(blocks, m, _LABELS[m[1]], m[2], close, code)
        for kind, names in re.findall(r"\b(extends|implements|with)\s+([\w.,<>\s]+?)(?=\bextends\b|\bimplements\b|\bwith\b|\{|$)", m[3] or ""):
            for x in re.sub(r"<[^>]*>", "", names).split(","):
                out.add("heritage", id=f"{_LABELS[m[1]]}:{path}:{m[2]}", name=x.strip().split(".")[-1], scope=module, type="IMPLEMENTS" if kind == "implements" else "EXTENDS", startLine=line(m.start()))
        if (c := re.match(r"\s*(?:\([^)]*\)\s*)?:\s*([^{]+)", m[3] or "")) and lang in ("csharp", "cpp", "kotlin", "swift"):
            for x in re.sub(r"<[^>]*>|\([^)]*\)|\b(public|private|protected|virtual)\b", "", c[1]).split(","):
                if x.strip():
                    out.add("heritage", id=f"{_LABELS[m[1]]}:{path}:{m[2]}", name=x.strip().split(".")[-1].split("::")[-1], scope=module, type="IMPLEMENTS" if lang == "csharp" and re.match(r"I[A-Z]", x.strip()) else "EXTENDS", startLine=line(m.start()))
        if lang == "ruby" and (c := re.match(r"\s*<\s*([\w:]+)", m[3] or "")):
            out.add("heritage", id=f"Class:{path}:{m[2]}", name=c[1].split("::")[-1], scope=module, type="EXTENDS", startLine=line(m.start()))
    if lang == "go":
        for m in _GO_TYPES.finditer(code):
            _block(blocks, m, _LABELS[m[2]], m[1], close, code)
    functions = [(m, m.groupdict()) for p in (_FUNCTION, _ARROW) for m in p.finditer(code)]
    if lang not in ("go", "ruby", "rust", "kotlin", "swift"):
        functions += [(m, m.groupdict()) for m in _TYPED.finditer(code) if m["name"] not in _KEYWORDS and (m["type"] or "").strip() not in ("return", "new", "else", "throw")]
    seen: set[int] = set()
    for m, g in sorted(functions, key=lambda x: x[0].start("name")):
        if m.start("name") in seen:
            continue
        seen.add(m.start("name"))
        _block(blocks, m, "Function", g["name"].split(".")[-1].split("::")[-1], close, code, g.get("args"), g.get("recv") or (g["name"].rpartition("::")[0] or None))
    blocks.sort(key=lambda b: (b[0], -b[1]))
    scopes: list[tuple[int, int, str, str, str]] = []
    scopes_all: list[tuple[int, int, str, str, str]] = []
    spans: list[tuple[int, int, str]] = []
    for b in blocks:
        start, end, label, name, extra = b[:5]
        while scopes and scopes[-1][1] < start:
            scopes.pop()
        parent = scopes[-1] if scopes else None
        owner = parent[4] if parent and parent[2] not in ("Function", "Method", "Constructor") else None
        if label == "Function":
            if extra[1]:
                words = re.findall(r"[A-Za-z_]\w*", extra[1])
                owner = f"Struct:{path}:{words[-1]}" if words else owner
            if owner:
                cls = owner.rsplit(":", 1)[-1]
                label = "Constructor" if name in (cls, "constructor", "__construct", "init") else "Method"
        qualified = (owner.rsplit(":", 1)[-1] + "." if owner else "") + name
        n = _arity(extra[0]) if label in ("Function", "Method", "Constructor") else None
        key = out.definition(label, qualified, name, parent[3] if parent else module, line(start), line(end), required=None if n is None else n - (extra[0] or "").count("=") - (extra[0] or "").count("?"), count=n)
        own = f"scope:{path}:{qualified}:{line(start)}"
        out.scope(own, parent[3] if parent else module, "Function" if label in ("Function", "Method", "Constructor") else "Class", line(start), line(end))
        out.add("owned", id=key, scope=own, label=label)
        if owner:
            out.add("member", id=key, name=name, label=label, parent=owner)
        scopes.append((start, end, label, own, key))
        scopes_all.append(scopes[-1])
        spans.append((start, end, own))
    # Blocks nest: a sweep over their ends gives the innermost block of every stretch once, calls and accesses look theirs up.
    cuts, inner_of, open_blocks = [0], [module], []
    for at, opens, end, own in sorted([(s, 1, e, o) for s, e, o in spans] + [(e + 1, 0, e, o) for s, e, o in spans], key=lambda x: (x[0], x[1], -x[2])):
        open_blocks = open_blocks + [own] if opens else [o for o in open_blocks if o != own]
        cuts.append(at)
        inner_of.append(open_blocks[-1] if open_blocks else module)
    innermost = lambda at: inner_of[bisect_right(cuts, at) - 1]
    for m in _ACCESS.finditer(code):
        write = re.match(r"\s*(?:[-+*/%&|^]|<<|>>)?=(?![=>])", code[m.end() : m.end() + 8])
        out.add("access", name=m["name"], scope=innermost(m.start()), receiver=m["recv"], form="write" if write else "read", startLine=line(m.start()))
    for m in _FIELD.finditer(code):
        owner = next((x for x in reversed(scopes_all) if x[0] < m.start() <= x[1] and x[2] not in ("Function", "Method", "Constructor")), None)
        if owner is not None and innermost(m.start("name")) == owner[3] and m["name"] not in _KEYWORDS:
            key = out.definition("Property", f"{owner[4].rsplit(':', 1)[-1]}.{m['name']}", m["name"], owner[3], line(m.start("name")), line(m.start("name")), type=(m["type"] or "").strip() or None)
            out.add("member", id=key, name=m["name"], label="Property", parent=owner[4])
            if m["type"]:
                out.add("annotation", name=m["name"], scope=owner[3], type=m["type"].strip(), startLine=line(m.start("name")))
    for m in _CALL.finditer(code):
        name = m["name"]
        if name in _KEYWORDS or m.start("name") in seen:
            continue
        scope = innermost(m.start())
        depth, at = 1, m.end()
        while at < len(code) and depth:
            depth += {"(": 1, ")": -1}.get(code[at], 0)
            at += 1
        form = "constructor" if m["new"] else "member" if m["recv"] else "free"
        out.add("call", name=name, scope=scope, form=form, receiver=m["recv"] or "", arity=_arity(text[m.end() : at - 1].strip() or None) if text[m.end() : at - 1].strip() else 0, startLine=line(m.start()))
    for form, pattern in _IMPORTS:
        for m in pattern.finditer(text):
            target, g = m["target"], m.groupdict()
            names = re.sub(r"[{}]", "", g.get("names") or "").split(",") if g.get("names") else [g.get("alias") or re.split(r"[./:\\]+", target.removesuffix(".*").rstrip("/"))[-1]]
            for x in names:
                imported, _, local = x.strip().partition(" as ")
                if imported:
                    kind = "wildcard" if target.endswith("*") else "namespace" if imported == "*" else form
                    out.add("import", name=(local or imported).strip(), scope=module, target=re.sub(r"\.\*$", "", target).replace("::", "/").replace("\\", "/") if "/" in target or target.startswith(".") else re.sub(r"\.\*$", "", target).replace(".", "/").replace("::", "/"), parent=imported.strip(), form=kind, startLine=line(m.start()))
    return out.rows


def _block(blocks: list, m, label: str, name: str, close: dict[int, int], code: str, args: str | None = None, recv: str | None = None) -> None:
    opening = code.find("{", m.start() if code[m.end() - 1 : m.end()] == "{" else m.end() - 1)
    between = code[m.end() : opening] if opening >= 0 else ";"
    if opening in close and "\n\n" not in between and ";" not in between:
        end = close[opening]
    else:
        end = close.get(-m.start() - 1, code.find("\n", m.end()) if "\n" in code[m.end() :] else len(code))
    blocks.append((m.start(), end, label, name, (args, recv)))


def _closings(code: str, lang: str) -> dict[int, int]:
    """Where each opening brace closes; for Ruby, where the block that begins at -(place + 1) ends."""
    out, stack = {}, []
    if lang == "ruby":
        for m in re.finditer(r"^[ \t]*(?:def|class|module|if|unless|while|until|case|begin|for)\b|\bdo\b(?=[^\n]*$)|^[ \t]*end\b", code, re.M):
            if m[0].strip() == "end":
                if stack:
                    out[stack.pop()] = m.end()
            else:
                stack.append(-(m.end() - len(m[0].lstrip())) - 1)
        return out
    for at in (m.start() for m in re.finditer(r"[{}]", code)):
        if code[at] == "{":
            stack.append(at)
        elif stack:
            out[stack.pop()] = at
    return out


def extract(path: str, language: str | None, text: str | None) -> list[dict]:
    """The facts of one file; a file that cannot be read as its language gives one `error` fact."""
    text = text or ""
    try:
        if language == "python":
            return _Python(path, text).out.rows
        if language in ("vue", "svelte", "astro"):
            return [r for shift, kind, code in script_blocks(path, text) for r in _generic(path, code, kind, shift)]
        if language in ("javascript", "typescript", "java", "c", "cpp", "csharp", "go", "ruby", "rust", "php", "kotlin", "swift", "dart"):
            return _generic(path, text, language)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [{"filePath": path, "fact": "error", "name": str(e)[:200], "seq": 0}]
    return []


def facts(files: DataFrame) -> DataFrame:
    """One row for each fact of each file (filePath, language, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for f in batch.itertuples() for r in extract(f.filePath, f.language, f.content)]
            out = pd.DataFrame(rows, columns=_COLUMNS)
            for c in ("startLine", "endLine", "arity", "required", "count", "seq"):
                out[c] = out[c].astype("Int32")
            yield out.astype({c: object for c in _COLUMNS if c not in ("startLine", "endLine", "arity", "required", "count", "seq")}).where(out.notna(), None)

    return files.select("filePath", "language", "content").mapInPandas(run, FACTS)
