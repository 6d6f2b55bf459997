"""A light syntax tree for Go, TypeScript and Python: functions, statements, branches, comments.

Go and TypeScript are read by tokens and braces, Python by the standard library's parser; all give the same nodes. What
cannot be read raises ``ValueError``.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<num>\d[\w.]*)|(?P<id>[A-Za-z_$][\w$]*)
    |(?P<op>=>|:=|\.\.\.|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|<-|[-+*/%&|^]=|[^\s\w])|(?P<nl>\n)""",
    re.S | re.X,
)
CONTROL = {"if", "for", "while", "switch", "select", "try", "catch", "finally", "else", "do", "with"}
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
CONTINUES = {".", "+", "-", "*", "/", "%", "&&", "||", "?", ":", "=", ":=", ",", "==", "===", "!=", "!==", "<", ">", "(", "[", "{", "=>", "&", "|", "??", "+=", "-=", "<=", ">="}


@dataclass
class Token:
    kind: str
    text: str
    line: int


@dataclass
class Node:
    """A statement. head: its tokens without nested blocks; blocks: nested statement lists, by label."""

    kind: str
    head: list[str]
    line: int
    end: int
    blocks: list[tuple[str, list[Node]]] = field(default_factory=list)

    def key(self) -> str:
        return " ".join(self.head) + "".join(f" {{{label} {body_key(b)}}}" for label, b in self.blocks)

    def block(self, label: str) -> list[Node] | None:
        return next((b for n, b in self.blocks if n == label), None)


@dataclass
class Func:
    name: str
    receiver: str
    params: list[tuple[str, str]]
    results: list[str]
    body: list[Node]
    line: int
    end: int
    doc: str = ""
    decorators: list[str] = field(default_factory=list)
    exported: bool = False
    own: str = ""  # the name of a method's receiver inside it
    generics: list[str] = field(default_factory=list)


@dataclass
class Unit:
    lang: str
    funcs: list[Func]
    top: list[Node]
    comments: list[tuple[int, str]]
    lines: int


def body_key(nodes: list[Node]) -> str:
    return "; ".join(n.key() for n in nodes)


def walk(nodes: list[Node], path: tuple[Node, ...] = ()):
    """(node, ancestors, siblings, index) of all statements, outer ones first."""
    for i, n in enumerate(nodes):
        yield n, path, nodes, i
        for _, b in n.blocks:
            yield from walk(b, (*path, n))


def statements(nodes: list[Node]) -> int:
    """Statements inside; a switch counts one for each case and its longest case."""
    total = 0
    for n in nodes:
        if n.kind == "switch":
            sizes = [statements(b) for _, b in n.blocks]
            total += 1 + len(sizes) + max(sizes, default=0)
        else:
            total += 1 + sum(statements(b) for _, b in n.blocks)
    return total


def scan(text: str) -> list[Token]:
    out, line, at = [], 1, 0
    for m in TOKEN.finditer(text):
        line += text.count("\n", at, m.start())
        out.append(Token(m.lastgroup, m.group(), line))
        line += m.group().count("\n")
        at = m.end()
    return out


class Braces:
    """Statements of a brace language."""

    def __init__(self, text: str, lang: str):
        every = scan(text)
        self.lang = lang
        self.comments = [(t.line, t.text) for t in every if t.kind == "comment"]
        self.t = [t for t in every if t.kind != "comment"]
        self.t.append(Token("end", "", every[-1].line if every else 1))
        self.i = 0
        self.funcs: list[Func] = []

    def peek(self, skip: bool = False) -> Token:
        if skip:
            while self.t[self.i].kind == "nl":
                self.i += 1
        return self.t[self.i]

    def ahead(self) -> Token:
        """The next token that is no line end."""
        i = self.i
        while self.t[i].kind == "nl":
            i += 1
        return self.t[i]

    def block(self) -> tuple[list[Node], int]:
        """Statements up to the closing brace; the opening one was read."""
        out = []
        while True:
            t = self.peek(True)
            if t.text == "}":
                self.i += 1
                return out, t.line
            if t.kind == "end":
                raise ValueError(f"line {t.line}: a brace is not closed")
            if t.text == ";":
                self.i += 1
                continue
            out.append(self.statement())

    def statement(self) -> Node:
        t = self.peek(True)
        if t.text in ("switch", "select"):
            return self.switch(t)
        if t.text in CONTROL:
            return self.control(t)
        if t.text in ("case", "default"):
            raise ValueError(f"line {t.line}: {t.text} outside of a switch")
        return self.simple(t)

    def head(self, stop_at_brace: bool) -> list[str]:
        """Tokens up to the end of the statement or to the brace of its block; inner brackets are read whole."""
        out: list[str] = []
        depth: list[str] = []
        while True:
            t = self.t[self.i]
            if t.kind == "end":
                if depth:
                    raise ValueError(f"line {t.line}: a bracket is not closed")
                return out
            if not depth:
                if t.text == "{" and stop_at_brace:
                    return out
                if t.text == "}" or t.text == ";" and not stop_at_brace:
                    return out
                if t.kind == "nl" and out:
                    nxt = self.ahead()
                    if not stop_at_brace and (self.lang == "go" and out[-1] not in CONTINUES or self.lang != "go" and out[-1] not in CONTINUES and nxt.text not in (".", "?", ":", "&&", "||", "+", "??")):
                        return out
            self.i += 1
            if t.kind == "nl":
                continue
            if t.text in OPEN:
                if t.text == "{" and not depth and not stop_at_brace and out and (out[-1] in (")", "=>") or set(out[:3]) & {"func", "function", "class"}):
                    self.i -= 1
                    return out  # a function literal or method: its body is a block
                depth.append(OPEN[t.text])
            elif t.text in CLOSE:
                if not depth or depth.pop() != t.text:
                    raise ValueError(f"line {t.line}: {t.text} closes nothing")
            out.append(t.text)

    def control(self, t: Token) -> Node:
        self.i += 1
        kind = t.text
        head = self.head(True)
        node = Node(kind, [kind, *head], t.line, t.line)
        if self.peek(True).text != "{":
            if kind in ("else", "do", "if", "for", "while"):  # a body without braces
                body = [self.statement()] if self.peek(True).text not in ("}", "") else []
                node.blocks.append(("then", body))
                return node
            raise ValueError(f"line {t.line}: {kind} without a block")
        self.i += 1
        body, node.end = self.block()
        node.blocks.append(("then", body))
        while True:
            mark = self.i
            nxt = self.peek(True)
            if kind in ("if", "else") and nxt.text == "else":
                self.i += 1
                other = self.peek(True)
                if other.text == "if":
                    inner = self.control(other)
                    node.blocks.append(("else", [inner]))
                    node.end = inner.end
                else:
                    if other.text != "{":
                        one = self.statement()
                        node.blocks.append(("else", [one]))
                        node.end = one.end
                        return node
                    self.i += 1
                    body, node.end = self.block()
                    node.blocks.append(("else", body))
                return node
            if kind == "try" and nxt.text in ("catch", "finally"):
                self.i += 1
                self.head(True)
                if self.peek(True).text != "{":
                    raise ValueError(f"line {nxt.line}: {nxt.text} without a block")
                self.i += 1
                body, node.end = self.block()
                node.blocks.append((nxt.text, body))
                continue
            self.i = mark
            return node

    def switch(self, t: Token) -> Node:
        self.i += 1
        node = Node("switch", [t.text, *self.head(True)], t.line, t.line)
        if self.peek(True).text != "{":
            raise ValueError(f"line {t.line}: switch without a block")
        self.i += 1
        while True:
            c = self.peek(True)
            if c.text == "}":
                self.i += 1
                node.end = c.line
                return node
            if c.text not in ("case", "default"):
                raise ValueError(f"line {c.line}: {c.text!r} in a switch before its first case")
            label = []
            depth = 0
            while True:
                x = self.peek(True)
                self.i += 1
                if x.kind == "end":
                    raise ValueError(f"line {c.line}: a case is not ended")
                depth += (x.text in OPEN) - (x.text in CLOSE)
                if x.text == ":" and not depth:
                    break
                label.append(x.text)
            body = []
            while self.peek(True).text not in ("case", "default", "}"):
                if self.peek().text == ";":
                    self.i += 1
                    continue
                body.append(self.statement())
            node.blocks.append((" ".join(label), body))

    def simple(self, t: Token) -> Node:
        head, blocks = self.head(False), []
        end = t.line
        while self.t[self.i].text == "{" and head:
            self.i += 1
            whole = list(head)
            body, end = self.block()
            blocks.append(("body", body))
            self.function(whole, body, t.line, end)
            head.append("{}")
            if self.t[self.i].kind in ("nl", "end"):
                break
            head += self.head(False)
        if not head:
            raise ValueError(f"line {t.line}: {t.text!r} begins no statement")
        if self.t[self.i].text == ";":
            self.i += 1
        kind = "return" if head[0] == "return" else "func" if blocks and head[0] in ("func", "function", "export", "async") else "class" if head[0] == "class" or head[:2] == ["export", "class"] else "simple"
        line_end = max(end, self.t[max(0, self.i - 1)].line if self.t[max(0, self.i - 1)].kind != "end" else end)
        return Node(kind, head, t.line, line_end, blocks)

    def function(self, head: list[str], body: list[Node], line: int, end: int) -> None:
        """Record the function a block belongs to, by its header's tokens."""
        if self.lang == "go":
            if head[:1] != ["func"] or len(head) < 3:
                return
            i, receiver, own = 1, "", ""
            if head[1] == "(":
                j = head.index(")")
                names = [x for x in head[2:j] if re.match(r"[A-Za-z_]", x)]
                receiver = ("*" if "*" in head[2:j] else "") + names[-1] if names else ""
                own = names[0] if len(names) > 1 else ""
                i = j + 1
            if i >= len(head) or not re.match(r"[A-Za-z_]", head[i]):
                return
            name, rest, generics = head[i], head[i + 1 :], []
            if rest[:1] == ["["]:
                kinds, rest = group(["(", *rest[1 : rest.index("]")], ")"])[0], rest[rest.index("]") + 1 :]
                generics = [k[0] for k in kinds]
            params, after = group(rest)
            results = group(after)[0] if after[:1] == ["("] else [after] if after else []
            self.funcs.append(Func(name, receiver, go_params(params), [" ".join(r) for r in results if r], body, line, end, exported=name[:1].isupper(), own=own, generics=generics))
            return
        toks = [x for x in head if x not in ("export", "default", "async")]
        name = ""
        if toks[:1] == ["function"] and len(toks) > 1:
            name = toks[1]
            rest = toks[2:]
        elif "=>" in toks and "=" in toks:
            at = toks.index("=")
            name = toks[at - 1] if at else ""
            rest = toks[at + 1 :]
        else:
            return
        while rest and rest[0] != "(":
            rest = rest[1:]
        params, after = group(rest)
        kinds = [(p[0] if p[:1] != ["..."] else p[1] if len(p) > 1 else "", " ".join(p[2:] if p[1:2] == [":"] else p[1:])) for p in params if p]
        result = " ".join(x for x in after[1:] if x != "=>") if after[:1] == [":"] else ""
        self.funcs.append(Func(name, "", kinds, [result] if result and result != "void" else [], body, line, end, exported="export" in head[: len(head) - len(toks) + 1]))


def group(tokens: list[str]) -> tuple[list[list[str]], list[str]]:
    """Comma-separated parts of the first bracket, and the tokens after it."""
    if not tokens or tokens[0] != "(":
        return [], tokens
    parts, depth = [[]], 0
    for i, t in enumerate(tokens):
        if t in OPEN:
            depth += 1
            if depth == 1:
                continue
        if t in CLOSE:
            depth -= 1
            if not depth:
                return [p for p in parts if p], tokens[i + 1 :]
        if t == "," and depth == 1:
            parts.append([])
        else:
            parts[-1].append(t)
    return [p for p in parts if p], []


def go_params(parts: list[list[str]]) -> list[tuple[str, str]]:
    out, kind = [], ""
    named = any(len(p) > 1 and re.match(r"[A-Za-z_]", p[0]) and p[1] != "." for p in parts)
    for p in reversed(parts):
        if named and len(p) > 1:
            kind = "".join(p[1:])
            out.append((p[0], kind))
        elif named:
            out.append((p[0], kind))
        else:
            out.append(("_", "".join(p)))
    return out[::-1]


class _Python(ast.NodeVisitor):
    def __init__(self, text: str):
        self.funcs: list[Func] = []
        self.text = text

    def nodes(self, body: list[ast.stmt], owner: str = "") -> list[Node]:
        out = []
        for s in body:
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                inner = self.nodes(s.body)
                a = s.args
                names = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
                params = [(x.arg, ast.unparse(x.annotation) if x.annotation else "") for x in names]
                if owner and params and params[0][0] in ("self", "cls"):
                    params = params[1:]
                has = any(isinstance(r, ast.Return) and r.value is not None for r in ast.walk(s))
                doc = ast.get_docstring(s) or ""
                self.funcs.append(Func(s.name, owner, params, ["value"] if has else [], inner[1:] if doc else inner, s.lineno, s.end_lineno, doc, [ast.unparse(d) for d in s.decorator_list], not s.name.startswith("_")))
                out.append(Node("func", ["def", s.name], s.lineno, s.end_lineno, [("body", inner)]))
                continue
            head, kind, blocks = [type(s).__name__.lower()], "simple", []
            if isinstance(s, ast.ClassDef):
                kind, head, blocks = "class", ["class", s.name, *[ast.unparse(b) for b in s.bases]], [("body", self.nodes(s.body, s.name))]
            elif isinstance(s, (ast.If, ast.While)):
                kind = "if" if isinstance(s, ast.If) else "while"
                head, blocks = [kind, *_words(s.test)], [("then", self.nodes(s.body))]
            elif isinstance(s, (ast.For, ast.AsyncFor)):
                kind, head, blocks = "for", ["for", *_words(s.target), "in", *_words(s.iter)], [("then", self.nodes(s.body))]
            elif isinstance(s, (ast.Try, ast.TryStar)):
                kind, blocks = "try", [("then", self.nodes(s.body))]
                blocks += [("except " + (ast.unparse(h.type) if h.type else ""), self.nodes(h.body)) for h in s.handlers]
                blocks += [("finally", self.nodes(s.finalbody))] if s.finalbody else []
            elif isinstance(s, (ast.With, ast.AsyncWith)):
                kind, head, blocks = "with", ["with", *[w for i in s.items for w in _words(i)]], [("then", self.nodes(s.body))]
            elif isinstance(s, ast.Match):
                kind, head = "switch", ["match", *_words(s.subject)]
                blocks = [("case " + ast.unparse(c.pattern) + (" if " + ast.unparse(c.guard) if c.guard else ""), self.nodes(c.body)) for c in s.cases]
            elif isinstance(s, ast.Return):
                kind, head = "return", ["return", *(_words(s.value) if s.value else [])]
            else:
                head = _words(s)
            if getattr(s, "orelse", None):
                blocks.append(("else", self.nodes(s.orelse)))
            out.append(Node(kind, head, s.lineno, s.end_lineno, blocks))
        return out


def _words(node: ast.AST) -> list[str]:
    return [t.text for t in scan(ast.unparse(node)) if t.kind != "nl"]


def parse(text: str, lang: str) -> Unit:
    """The tree of a text; raises ValueError if it cannot be read."""
    lines = text.count("\n") + (1 if text and not text.endswith("\n") else 0)
    if lang == "py":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            raise ValueError(f"line {getattr(e, 'lineno', 0)}: {getattr(e, 'msg', e)}") from None
        p = _Python(text)
        try:
            top = p.nodes(tree.body)
        except RecursionError:
            raise ValueError("nested too deeply") from None
        comments = [(i, l.strip()) for i, l in enumerate(text.split("\n"), 1) if l.strip().startswith("#")]
        return Unit(lang, p.funcs, top, comments, lines)
    b = Braces(text, lang)
    top = []
    try:
        while b.peek(True).kind != "end":
            if b.peek().text == ";":
                b.i += 1
                continue
            top.append(b.statement())
    except RecursionError:
        raise ValueError("nested too deeply") from None
    docs: dict[int, str] = {}  # by the line below: the comments that stand directly above it, together
    for line, c in b.comments:
        above = docs.get(line, "")
        docs[line + c.count("\n") + 1] = (above + "\n" if above else "") + re.sub(r"^(//+|/\*+)\s*|\s*\*/$", "", c)
    for f in b.funcs:
        f.doc = docs.get(f.line, "")
    return Unit(lang, b.funcs, top, b.comments, lines)
