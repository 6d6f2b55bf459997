"""Facts along paths: which conditions are decided before they are asked, which cases are never reached.

A state maps names, fields and lengths to what is known of them: a value, values they cannot be, bounds. Statements turn a
set of states into another; a set beyond ``MAX_STATES`` is merged into what all its members agree on. Conditions are
and/or/not of comparisons with constants and of calls; anything else is unknown. A state may also tie a name to another
(``y := x``) or to a condition (``ok := x != nil``). Calls of functions of the same file are known by their summaries:
what holds of their arguments if they give true, false or nil, found by analysing the functions until nothing changes.

Names that a function literal writes, or whose address is taken, are not followed. Functions with ``goto`` or jumps to
labels are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field, replace
from functools import lru_cache

from strataloom.frontends.syntax import Func, Node, go_params, group, walk

MAX_STATES = 32
#: Spellings of the constants in the three languages (fixed values).
CONSTANTS = {"true": "true", "True": "true", "false": "false", "False": "false", "nil": "nil", "null": "nil", "None": "nil"}
NEGATED = {"==": "!=", "!=": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
REVERSED = {"==": "==", "!=": "!=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}
SAME = {"===": "==", "!==": "!=", "is": "=="}
#: Calls that change nothing they are given.
PURE = {"len", "cap", "append", "string", "int", "int64", "float64", "bool", "str", "min", "max", "make", "new", "isinstance", "String", "Number", "Boolean"}
INF = float("inf")


@dataclass(frozen=True)
class Fact:
    """One value, or excluded ones and bounds; a bound may be open."""

    value: str | None = None
    nots: frozenset[str] = frozenset()
    low: tuple[float, bool] = (-INF, True)
    high: tuple[float, bool] = (INF, True)


UNKNOWN = Fact()
State = dict  # name -> Fact; "=name" -> the name it stands for; "?name" -> the condition it holds
Condition = tuple  # ("and"|"or", parts), ("not", part), ("cmp", name, op, constant), ("call", name, arguments), ("unknown",)


@lru_cache(maxsize=100_000)
def root(name: str) -> str:
    """The plain name that a field or a length belongs to."""
    return name.removeprefix("len(").removesuffix(")").split(".")[0]


@lru_cache(maxsize=100_000)
def number(x: str) -> float | None:
    try:
        return float(int(x.replace("_", ""), 0)) if re.match(r"[-+]?\d[\d_]*$|[-+]?0[xXbBoO]", x) else float(x)
    except (ValueError, OverflowError):  # too large for a float: a constant whose size is not known
        return None


def _constant(tokens: list[str]) -> str | None:
    """The constant a list of tokens is, in one spelling."""
    t = tokens[1:] if tokens[:1] in (["-"], ["+"]) and len(tokens) == 2 and tokens[1][:1].isdigit() else tokens
    if len(t) != 1:
        return None
    x = t[0]
    if x in CONSTANTS:
        return CONSTANTS[x]
    if x[:1].isdigit():
        n = number(x)
        return None if n is None else f"{-n if tokens[0] == '-' else n:g}"
    return x if x[:1] in "\"'`" else None


def name_of(tokens: list[str]) -> str | None:
    """A name, a field of one (``a.b``), or a length (``len(a)``), as one string."""
    if tokens[:2] == ["len", "("] and tokens[-1:] == [")"]:
        inner = name_of(tokens[2:-1])
        return f"len({inner})" if inner and not inner.startswith("len(") else None
    if len(tokens) % 2 and all((t == ".") if i % 2 else (t[:1].isalpha() or t[:1] in "_$") and t not in CONSTANTS for i, t in enumerate(tokens)):
        return "".join(tokens)
    return None


def _length(name: str) -> bool:
    return name.startswith("len(") or name.endswith(".length")


def _closes(t: list[str]) -> int:
    depth = 0
    for i, x in enumerate(t):
        depth += (x in ("(", "[", "{")) - (x in (")", "]", "}"))
        if not depth:
            return i
    return -1


def condition(tokens: list[str]) -> Condition:
    """The condition of a list of tokens."""
    t = [{"&&": "and", "||": "or"}.get(x, x) for x in tokens]
    while len(t) > 2 and t[0] == "(" and _closes(t) == len(t) - 1:
        t = t[1:-1]
    for word in ("or", "and"):
        depth, parts, last = 0, [], 0
        for i, x in enumerate(t):
            depth += (x in ("(", "[", "{")) - (x in (")", "]", "}"))
            if x == word and not depth:
                parts.append(t[last:i])
                last = i + 1
        if parts:
            return (word, tuple(condition(p) for p in [*parts, t[last:]]))
    if t[:1] in (["!"], ["not"]):
        return ("not", condition(t[1:]))
    depth = 0
    for i, x in enumerate(t):
        depth += (x in ("(", "[", "{")) - (x in (")", "]", "}"))
        op = SAME.get(x, x)
        if op in NEGATED and not depth:
            left, right = t[:i], t[i + 1 :]
            if x == "is" and right[:1] == ["not"]:
                op, right = "!=", right[1:]
            a, b, c, d = name_of(left), name_of(right), _constant(left), _constant(right)
            if a and d is not None:
                return ("cmp", a, op, d)
            return ("cmp", b, REVERSED[op], c) if b and c is not None else ("unknown",)
    if t[1:2] == ["("] and t[-1] == ")" and name_of(t[:1]) and t[0] not in PURE and _closes(t[1:]) == len(t) - 2:
        return ("call", t[0], tuple(name_of(a) for a in group(t[1:])[0]))
    n = name_of(t)
    return ("cmp", n, "==", "true") if n and not _length(n) else ("unknown",)


def holds(f: Fact, op: str, c: str) -> bool | None:
    """Three-valued truth of ``fact op constant``."""
    if op == "!=":
        t = holds(f, "==", c)
        return None if t is None else not t
    n = number(c)
    if f.value is not None:
        v = number(f.value)
        if op == "==":
            return f.value == c or v is not None and v == n
        return None if v is None or n is None else {"<": v < n, "<=": v <= n, ">": v > n, ">=": v >= n}[op]
    if op == "==":
        out = n is not None and (n < f.low[0] or n > f.high[0] or n == f.low[0] and f.low[1] or n == f.high[0] and f.high[1])
        return False if c in f.nots or out else None
    if n is None:
        return None
    below, above = f.high[0] < n or f.high == (n, True), f.low[0] > n or f.low == (n, True)  # all of it is
    at_most, at_least = f.high[0] <= n, f.low[0] >= n
    yes, no = {"<": (below, at_least), "<=": (at_most, above), ">": (above, at_most), ">=": (at_least, below)}[op]
    return True if yes else False if no else None


def narrowed(f: Fact, op: str, c: str) -> Fact:
    """The fact with ``op constant`` added."""
    n = number(c)
    if op == "==":
        return Fact(c)
    if op == "!=":
        if c in ("true", "false"):
            return Fact("false" if c == "true" else "true")
        f = replace(f, nots=f.nots | {c})
        if n is not None and f.low == (n, False):
            f = replace(f, low=(n, True))
        return replace(f, high=(n, True)) if n is not None and f.high == (n, False) else f
    if n is None:
        return f
    if op in (">", ">="):
        return replace(f, low=max(f.low, (n, op == ">")))
    return replace(f, high=min([f.high, (n, op == "<")], key=lambda b: (b[0], not b[1])))  # of equal bounds the open one


def _joined(a: Fact, b: Fact) -> Fact:
    if a == b:
        return a
    excluded = lambda x, y: frozenset(c for c in x.nots if holds(y, "==", c) is False)
    bound = lambda x: ((number(x.value), False),) * 2 if x.value is not None and number(x.value) is not None else ((-INF, True), (INF, True)) if x.value is not None else (x.low, x.high)
    (la, ha), (lb, hb) = bound(a), bound(b)
    return Fact(None, excluded(a, b) | excluded(b, a), min(la, lb), max(ha, hb, key=lambda x: (x[0], not x[1])))


def merge(states: list[State]) -> State:
    """What all states agree on: equal values stay, excluded ones are intersected, bounds widened."""
    out = dict(states[0])
    for s in states[1:]:
        for k in list(out):
            if k not in s:
                del out[k]
            elif isinstance(out[k], Fact):
                out[k] = _joined(out[k], s[k])
                if out[k] == UNKNOWN:
                    del out[k]
            elif out[k] != s[k]:
                del out[k]
    return out


def bounded(states: list[State], most: int = MAX_STATES) -> list[State]:
    seen, out = set(), []
    for s in states:
        k = frozenset(s.items())
        if k not in seen:
            seen.add(k)
            out.append(s)
    return out if len(out) <= most else [merge(out)]


@dataclass
class Summary:
    """What a call tells: by the constant given, (parameter, op, constant) that then hold; what it can give; what it
    guarantees whenever it comes back."""

    params: list[str]
    by_result: dict[str, list[tuple[int, str, str]]] = field(default_factory=dict)
    gives: frozenset[str] = frozenset(["?"])
    ensures: list[tuple[int, str, str, str]] = field(default_factory=list)  # parameter, field of it, op, constant


class Facts:
    """Truth and refinement of conditions, given the summaries of a file."""

    def __init__(self, summaries: dict[str, Summary] | None = None, hidden: frozenset[str] = frozenset()):
        self.summaries, self.hidden = summaries or {}, hidden

    def tracked(self, name: str) -> bool:
        return root(name) not in self.hidden

    def get(self, s: State, name: str) -> Fact:
        f = s.get(name)
        if f is None:
            return Fact(low=(0.0, False)) if _length(name) else UNKNOWN
        return f

    def truth(self, s: State, c: Condition) -> bool | None:
        if c[0] in ("and", "or"):
            decisive, known = c[0] == "or", s
            got = []
            for part in c[1]:
                got.append(self.truth(known, part))
                if got[-1] is decisive:
                    return decisive
                after = self.refine(known, part, not decisive)
                known = merge(after) if after else known
            return None if None in got else not decisive
        if c[0] == "not":
            t = self.truth(s, c[1])
            return None if t is None else not t
        if c[0] == "cmp":
            t = holds(self.get(s, c[1]), c[2], c[3])
            if t is None and c[2] in ("==", "!=") and c[3] in ("true", "false") and "?" + c[1] in s:
                t = self.truth(s, s["?" + c[1]])
                t = None if t is None else t == ((c[3] == "true") == (c[2] == "=="))
            return t
        if c[0] == "call" and c[1] in self.summaries:
            gives = self.summaries[c[1]].gives
            return True if gives == {"true"} else False if gives == {"false"} else None
        return None

    def refine(self, s: State, c: Condition, want: bool) -> list[State]:
        """The states in which the condition comes out as wanted."""
        if c[0] == "not":
            return self.refine(s, c[1], not want)
        if c[0] in ("and", "or"):
            if (c[0] == "and") == want:
                states = [s]
                for part in c[1]:
                    states = [x for y in states for x in self.refine(y, part, want)]
                return states
            out, rest = [], [s]
            for part in c[1]:
                out += [x for y in rest for x in self.refine(y, part, want)]
                rest = [x for y in rest for x in self.refine(y, part, not want)]
            return out
        t = self.truth(s, c)
        if t is not None:
            return [s] if t is want else []
        if c[0] == "cmp":
            op = c[2] if want else NEGATED[c[2]]
            if op in ("==", "!=") and c[3] in ("true", "false") and "?" + c[1] in s:
                is_true = (c[3] == "true") == (op == "==")
                return [self.put(x, c[1], "==", "true" if is_true else "false") for x in self.refine({k: v for k, v in s.items() if k != "?" + c[1]}, s["?" + c[1]], is_true)]
            return [self.put(s, c[1], op, c[3])]
        if c[0] == "call" and c[1] in self.summaries:
            return [self.applied(s, self.summaries[c[1]].by_result.get("true" if want else "false", []), c[2])]
        return [s]

    def put(self, s: State, name: str, op: str, constant: str) -> State:
        """The state with a fact added, also for the names that stand for the same."""
        if not self.tracked(name):
            return s
        s = dict(s)
        root = s.get("=" + name, name)
        for n in {name, root, *(k[1:] for k, v in s.items() if k[0] == "=" and v == root)}:
            s[n] = narrowed(self.get(s, n), op, constant)
            if _length(n) and n.startswith("len(") and holds(s[n], ">", "0"):
                s[n[4:-1]] = narrowed(self.get(s, n[4:-1]), "!=", "nil")
            if op == "==" and constant == "nil":
                s[f"len({n})"] = Fact("0")
        return s

    def applied(self, s: State, facts: list[tuple[int, str, str]], args: tuple) -> State:
        for i, op, constant in facts:
            if i < len(args) and args[i]:
                s = self.put(s, args[i], op, constant)
        return s

    def forget(self, s: State, names: set[str], fields: bool = False) -> State:
        """Without what is known of these names, their fields and lengths, and with ``fields`` of any field."""
        stale = lambda n: root(n) in names or n in names or fields and "." in n
        out = {}
        for k, v in s.items():
            if k[0] == "=":
                gone = stale(k[1:]) or stale(v)
            elif k[0] == "?":
                gone = stale(k[1:]) or any(stale(x) for x in mentioned(v))
            else:
                gone = stale(k)
            if not gone:
                out[k] = v
        return out


def mentioned(c: Condition) -> list[str]:
    if c[0] in ("and", "or"):
        return [n for p in c[1] for n in mentioned(p)]
    return mentioned(c[1]) if c[0] == "not" else [c[1]] if c[0] == "cmp" else [a for a in c[2] if a] if c[0] == "call" else []


ASSIGNS = ("=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "++", "--", "in", "range")


def written(nodes: list[Node]) -> set[str]:
    """Names that statements may change: assigned ones, and those handed to calls by address."""
    out: set[str] = set()
    for n, _, _, _ in walk(nodes):
        h = n.head
        for i, x in enumerate(h):
            if x in ASSIGNS:
                out |= {y for y in h[:i] if y[:1].isalpha() or y[:1] == "_"}
            if x == "&" and i + 1 < len(h):
                out.add(h[i + 1])
    return out


def _hidden(f: Func) -> frozenset[str]:
    """Names written in function literals or handed out by address."""
    out: set[str] = set()
    for n, _, _, _ in walk(f.body):
        h = n.head
        out |= {h[i + 1] for i, x in enumerate(h[:-1]) if x == "&" and (not i or h[i - 1] in ("(", ",", "=", ":=", "return", "{", "[", ":"))}
        for label, b in n.blocks:
            if label == "body":
                out |= written(b)
    return frozenset(out)


def _jumps(f: Func) -> bool:
    return any(n.head[:1] == ["goto"] or n.head[:1] in (["break"], ["continue"]) and len(n.head) > 1 for n, _, _, _ in walk(f.body))


@dataclass
class Flow:
    """Where the states of a statement list go."""

    next: list[State]
    breaks: list[State] = field(default_factory=list)
    continues: list[State] = field(default_factory=list)


class Interpreter:
    """Runs the statements of one function over sets of states."""

    def __init__(self, f: Func, lang: str, summaries: dict[str, Summary] | None = None):
        self.f, self.lang = f, lang
        self.facts = Facts(summaries, _hidden(f))
        self.locals = {p for p, _ in f.params} | {x for n, _, _, _ in walk(f.body) if ":=" in n.head for x in n.head[: n.head.index(":=")]}
        if lang != "go":
            self.locals |= {n.head[0] for n, _, _, _ in walk(f.body) if n.head[1:2] == ["="]} | {n.head[1] for n, _, _, _ in walk(f.body) if n.head[:1] in (["const"], ["let"], ["var"]) and len(n.head) > 1}
        self.found: list[tuple[int, str, str]] = []
        self.returned: list[tuple[str, State]] = []

    def run(self) -> None:
        end = self.block(self.f.body, [{}])
        self.returned += [("nothing", s) for s in end.next]

    def block(self, nodes: list[Node], states: list[State]) -> Flow:
        out = Flow(states)
        for n in nodes:
            if not out.next:
                break
            step = self.statement(n, out.next)
            out = Flow(bounded(step.next), out.breaks + step.breaks, out.continues + step.continues)
        return out

    def statement(self, n: Node, states: list[State]) -> Flow:
        h = n.head
        for label, b in n.blocks:
            if label == "body":  # a function literal or a local function: on its own, from any state
                self.apart(b)
        if n.kind == "if":
            return self.branch(n, states)
        if n.kind in ("for", "while"):
            return self.loop(n, states)
        if n.kind == "switch" and self.lang == "go":
            return self.switch(n, states)
        if h[:1] == ["return"]:
            states = self.called(h[1:], states)
            self.returned += [(self.given(h[1:], s), s) for s in states]
            return Flow([])
        if h[:1] in (["raise"], ["throw"]) or h[:2] == ["panic", "("] or h[:4] in (["os", ".", "Exit", "("], ["process", ".", "exit", "("]):
            return Flow([])
        if h[:1] == ["break"]:
            return Flow([], states)
        if h[:1] == ["continue"]:
            return Flow([], [], states)
        if n.blocks and any(label != "body" for label, _ in n.blocks):
            return self.other(n, states)
        return Flow([self.assigned(h, s) for s in self.called(h, states)])

    def apart(self, nodes: list[Node]) -> None:
        inner = Interpreter(replace(self.f, body=nodes), self.lang, self.facts.summaries)
        inner.facts.hidden |= self.facts.hidden
        inner.block(nodes, [{}])
        self.found += inner.found

    def given(self, tokens: list[str], s: State) -> str:
        """The constant a return gives, as far as it is known; for several results, of the last one."""
        parts = group(["(", *tokens, ")"])[0]
        if not parts:
            return "nothing"
        c = _constant(parts[-1])
        if c is not None:
            return c
        n = name_of(parts[-1])
        f = self.facts.get(s, n) if n else UNKNOWN
        if f.value is not None:
            return f.value
        t = self.facts.truth(s, condition(parts[-1]))
        return str(t).lower() if t is not None else "not nil" if "nil" in f.nots else "?"

    def called(self, tokens: list[str], states: list[State]) -> list[State]:
        """What calls in an expression leave of the states: fields and names of others may have changed."""
        calls = [i for i in range(len(tokens) - 1) if tokens[i + 1] == "(" and (tokens[i][:1].isalpha() or tokens[i][:1] == "_") and tokens[i] not in PURE and tokens[i] not in ("func", "if", "for", "while", "switch", "return", "and", "or", "not", "in")]
        if not calls:
            return states
        receivers = {tokens[i - 2] for i in calls if i > 1 and tokens[i - 1] == "."}
        out = []
        for s in states:
            others = {root(k) for k in s if k[0] not in "=?"} - self.locals
            kept = {k: s[k] for k in receivers if k in s and k not in others and (s[k].value == "nil" or "nil" in s[k].nots)}
            s = self.facts.forget(s, others | receivers, True) | kept
            for i in calls:
                if tokens[i] in self.facts.summaries and (not i or tokens[i - 1] != "."):
                    args = tuple(name_of(a) for a in group(tokens[i + 1 :])[0])
                    for p, path, op, constant in self.facts.summaries[tokens[i]].ensures:
                        if p < len(args) and args[p]:
                            s = self.facts.put(s, args[p] + path, op, constant)
            out.append(s)
        return out

    def assigned(self, h: list[str], s: State) -> State:
        at = 1 if h[:1] in (["const"], ["let"], ["var"]) else 0
        changed = written([Node("simple", h, 0, 0)])
        fields = {h[i + 1] for i in range(len(h) - 1) if h[i] == "."}
        s = self.facts.forget(s, changed - fields | {h[0]} if changed else set(), bool(changed & fields))
        op = next((i for i, x in enumerate(h) if x in ("=", ":=")), -1)
        target = name_of(h[at:op]) if op > at else None
        if not target or not self.facts.tracked(target):
            return s
        value = h[op + 1 :]
        c, source, cond = _constant(value), name_of(value), condition(value)
        if c is not None:
            return self.facts.put(s, target, "==", c)
        if source and self.facts.tracked(source) and source != target and not _length(source):
            s = dict(s)
            s["=" + target] = s.get("=" + source, source)
            if source in s:
                s[target] = s[source]
            if "?" + source in s:
                s["?" + target] = s["?" + source]
            return s
        if cond[0] in ("and", "or", "not", "call") or cond[0] == "cmp" and cond[1] != source:
            return {**s, "?" + target: cond}
        return s

    def decide(self, line: int, c: Condition, states: list[State]) -> None:
        got = {self.facts.truth(s, c) for s in states}
        if got in ({True}, {False}):
            if c[0] != "unknown":
                self.found.append((line, "redundant_condition", f"always {str(got.pop()).lower()}"))
        elif c[0] in ("and", "or"):
            so_far = states
            for part in c[1]:
                seen = {self.facts.truth(s, part) for s in so_far}
                if seen in ({True}, {False}) and part[0] != "unknown":
                    self.found.append((line, "redundant_subexpression", f"an operand is always {str(seen.pop()).lower()}"))
                so_far = [x for s in so_far for x in self.facts.refine(s, part, c[0] == "and")] or so_far

    def branch(self, n: Node, states: list[State]) -> Flow:
        head = n.head[1:]
        if ";" in head:
            first = head[: head.index(";")]
            states, head = [self.assigned(first, s) for s in self.called(first, states)], head[head.index(";") + 1 :]
        states = self.called(head, states)
        c = condition(head)
        self.decide(n.line, c, states)
        yes = self.block(n.block("then") or [], bounded([x for s in states for x in self.facts.refine(s, c, True)]))
        no = Flow(bounded([x for s in states for x in self.facts.refine(s, c, False)]))
        if n.block("else") is not None:
            no = self.block(n.block("else"), no.next)
        return Flow(yes.next + no.next, yes.breaks + no.breaks, yes.continues + no.continues)

    def loop(self, n: Node, states: list[State]) -> Flow:
        """Any number of rounds: what the loop writes is forgotten before it, after it the condition is false."""
        parts: list[list[str]] = [[]]
        for x in n.head[1:]:
            parts.append([]) if x == ";" else parts[-1].append(x)
        over = "range" in n.head or n.head[1:2] and self.lang == "py" and n.kind == "for" or "of" in n.head or "in" in n.head
        if len(parts) == 3:
            states = [self.assigned(parts[0], s) for s in self.called(parts[0], states)]
        test = [] if over else parts[1] if len(parts) == 3 else parts[0]
        changed = written([n])
        fields = any("(" in x.head or "." in x.head for x, _, _, _ in walk([n]))
        entry = bounded([self.facts.forget(s, changed | ({root(k) for k in s if k[0] not in "=?"} - self.locals if fields else set()), fields) for s in states])
        c = condition(test) if test else ("unknown",)
        body = self.block(n.block("then") or [], bounded([x for s in entry for x in self.facts.refine(s, c, True)]))
        if n.block("else") is not None:  # Python: runs unless the loop was left
            other = self.block(n.block("else"), entry)
            return Flow(other.next + body.breaks, other.breaks, other.continues)
        endless = not test and not over
        done = [] if endless else [x for s in entry for x in self.facts.refine(s, c, False)]
        return Flow(bounded(done + body.breaks))

    def switch(self, n: Node, states: list[State]) -> Flow:
        head = n.head[1:]
        if ";" in head:
            first = head[: head.index(";")]
            states, head = [self.assigned(first, s) for s in self.called(first, states)], head[head.index(";") + 1 :]
        plain = n.head[:1] == ["switch"] and "type" not in head and not any(b and b[-1].head == ["fallthrough"] for _, b in n.blocks)
        if not plain:
            return self.other(n, states)
        tag = name_of(head) if head else None
        rest, out = self.called(head, states), Flow([])
        for label, body in sorted(n.blocks, key=lambda x: x[0] == "default"):
            if label == "default":
                step = self.block(body, rest)
                rest = []
            else:
                options = _options(label.removeprefix("case ").split(" "))
                tests = [("cmp", tag, "==", _constant(o)) if tag and _constant(o) is not None else ("unknown",) if head else condition(o) for o in options]
                c = tests[0] if len(tests) == 1 else ("or", tuple(tests))
                got = {self.facts.truth(s, c) for s in rest}
                if got == {False} or not rest:
                    self.found.append((body[0].line - 1 if body else n.line, "unreachable_case", f"{' '.join(' '.join(o) for o in options)} was matched before"))
                step = self.block(body, bounded([x for s in rest for x in self.facts.refine(s, c, True)]))
                rest = bounded([x for s in rest for x in self.facts.refine(s, c, False)])
            out.next += step.next + step.breaks
            out.continues += step.continues
        return Flow(bounded(out.next + rest), [], out.continues)

    def other(self, n: Node, states: list[State]) -> Flow:
        """Blocks in any order, or not at all: nothing they write is known in or after them."""
        changed = written([n])
        entry = bounded([self.facts.forget(s, changed, True) for s in self.called(n.head, states)])
        out = Flow(list(entry))
        for label, b in n.blocks:
            if label != "body":
                step = self.block(b, [dict(s) for s in entry])
                out = Flow(out.next + step.next, out.breaks + step.breaks, out.continues + step.continues)
        if n.kind in ("switch", "select"):
            return Flow(bounded(out.next + out.breaks), [], out.continues)
        return Flow(bounded([self.facts.forget(s, changed, True) for s in out.next]), out.breaks, out.continues)


def _options(tokens: list[str]) -> list[list[str]]:
    return group(["(", *tokens, ")"])[0]


def closures(f: Func) -> list[Func]:
    """Function literals of a Go function that are given to a name once, as functions of that name."""
    out: dict[str, list[Func]] = {}
    for n, _, _, _ in walk(f.body):
        h = n.head
        if len(n.blocks) == 1 and n.blocks[0][0] == "body" and h[1:4] == [":=", "func", "("] and h[-1:] == ["{}"]:
            params, after = group(h[3:-1])
            results = group(after)[0] if after[:1] == ["("] else [after] if after else []
            out.setdefault(h[0], []).append(Func(h[0], "", go_params(params), [" ".join(r) for r in results if r], n.blocks[0][1], n.line, n.end))
        elif h[1:2] in (["="], [":="]) and h[0] in out:
            out[h[0]] += out[h[0]]  # given again: not known any more
    return [fs[0] for fs in out.values() if len(fs) == 1]


def summarise(funcs: list[Func], lang: str) -> dict[str, Summary]:
    """Summaries of the plain functions of a file, and of function literals with a name of their own: analysed again until
    none changes, at most once more than there are.

    A fact about an argument counts if it holds whenever the function gives that constant; arguments it assigns to are
    left out. Guarantees are those its comment states.
    """
    from strataloom.frontends.rules import ENSURES, contract

    if lang == "go":
        funcs = [*funcs, *(c for f in funcs for c in closures(f))]
    called: dict[str, set[str]] = {}
    for g in funcs:
        for n, _, _, _ in walk(g.body):
            for x, y in zip(n.head, n.head[1:], strict=False):
                if y == "(":
                    called.setdefault(x, set()).add(g.name)
    count = Counter(g.name for g in funcs)
    plain = {f.name: f for f in funcs if not f.receiver and count[f.name] == 1 and called.get(f.name)}  # what nobody calls needs none
    out: dict[str, Summary] = {}
    for name, f in plain.items():
        stated = [contract(l, {p for p, _ in f.params}) for l in f.doc.split("\n") if l.startswith(ENSURES)]
        names = [p for p, _ in f.params]
        out[name] = Summary(names, ensures=[(names.index(c[0].split(".")[0]), c[0][len(c[0].split(".")[0]) :], c[1], _constant([c[2]]) or c[2]) for c in stated if c])
    for _ in range(len(plain) + 1):
        changed = False
        for name, f in plain.items():
            if _jumps(f):
                continue
            run = Interpreter(f, lang, out)
            run.run()
            lost = written(f.body)
            gives = frozenset(r for r, _ in run.returned)
            by: dict[str, list[tuple[int, str, str]]] = {}
            for want in ("true", "false"):
                states = [s for r, s in run.returned if r in (want, "?", "not nil")]
                if not any(r == want for r, _ in run.returned) or any(r in ("?", "not nil") for r, _ in run.returned):
                    continue
                whole = merge(states) if states else {}
                for i, p in enumerate(out[name].params):
                    fact = whole.get(p)
                    if p in lost or not isinstance(fact, Fact):
                        continue
                    if fact.value is not None:
                        by.setdefault(want, []).append((i, "==", fact.value))
                    by.setdefault(want, []).extend((i, "!=", c) for c in sorted(fact.nots))
                    if fact.low[0] > -INF:
                        by.setdefault(want, []).append((i, ">" if fact.low[1] else ">=", f"{fact.low[0]:g}"))
                    if fact.high[0] < INF:
                        by.setdefault(want, []).append((i, "<" if fact.high[1] else "<=", f"{fact.high[0]:g}"))
            if (gives, by) != (out[name].gives, out[name].by_result):
                changed = True
                out[name] = replace(out[name], by_result=by, gives=gives)
        if not changed:
            break
    return out


def decided(f: Func, lang: str = "go", summaries: dict[str, Summary] | None = None) -> list[tuple[int, str, str]]:
    """Findings: conditions that are always true or always false where they stand, operands of them that are, and cases
    that are never reached."""
    if _jumps(f) or not any(n.kind in ("if", "switch") for n, _, _, _ in walk(f.body)):
        return []
    run = Interpreter(f, lang, summaries)
    run.run()
    return sorted(set(run.found))


def returns(f: Func) -> str:
    """What a function gives on all paths, as far as constants tell: always true, always false, always nil, or mixed."""
    if _jumps(f):
        return "mixed"
    run = Interpreter(f, "go")
    run.run()
    seen = {r for r, _ in run.returned if r != "nothing"}
    return f"always {seen.pop()}" if len(seen) == 1 and not seen & {"?", "not nil"} else "mixed" if seen else "nothing"
