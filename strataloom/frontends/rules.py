"""Rules on one file's syntax tree. Each yields (line, kind, message)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from strataloom.fixed import COMMENT_WORDS, GENERIC, NOISE
from strataloom.frontends.syntax import Func, Node, Unit, body_key, group, statements, walk

#: Limits (fixed values): lines of a file, statements, parameters and results of a function; runs of declarations.
FILE_LINES, STATEMENTS, PARAMS, RESULTS, RUN = 1000, 40, 6, 3, 10
MEMBERSHIP = {"Contains", "Index"}
#: Calls that sort, that leave the process and that build what does not change (fixed values).
SORTS = {"sort": {"Float64s", "Ints", "Slice", "SliceStable", "Sort", "Stable", "Strings"}, "slices": {"Sort", "SortFunc", "SortStableFunc"}}
NETWORK = {"Get", "Head", "Post", "PostForm"}
DATABASE = {"Exec", "ExecContext", "Query", "QueryContext", "QueryRow", "QueryRowContext"}
COMPILES = {
    "regexp": {"Compile", "CompilePOSIX", "MustCompile", "MustCompilePOSIX"},
    "strings": {"NewReplacer"},
    "template": {"Must", "ParseFiles", "ParseFS", "ParseGlob"},
}
COMPLEXITY_LINTERS = {"cyclop", "gocognit", "nestif"}
SLEEPS = re.compile(r"\b(?:time \. (?:Sleep|sleep)|asyncio \. sleep|setTimeout|sleep) \(")
FAKES = re.compile(r"useFakeTimers|fakeClock|monkeypatch|freeze_time|mock\.patch|synctest")
ASSERTS = re.compile(r"\b(?:t|b) \. (?:Error|Errorf|Fatal|Fatalf|Fail|FailNow)\b|\b(?:assert|require|expect|raises)\b|\bassertEqual\b|\bpanic \(|\blog \. (?:Fatal|Panic)|\bos \. Exit \(")
#: How an error is named, where no types are known.
ERROR = re.compile(r"err$|[a-z]\w*Err$|[eE]rr[A-Z]\w*$")
#: Directives in comments: why a test runs alone; what a function guarantees.
SERIAL, ENSURES = "strataloom:serial", "strataloom:ensures"

Finding = tuple[int, str, str]


def words(name: str) -> list[str]:
    cut = re.sub(r"([A-Z])([A-Z][a-z])", r"\1_\2", re.sub(r"([a-z])([A-Z])", r"\1_\2", name))
    return [w for w in cut.lower().split("_") if w]


def private(f: Func, lang: str) -> bool:
    return f.name[:1].islower() if lang == "go" else f.name.startswith("_") if lang == "py" else True


def test_func(f: Func, lang: str) -> bool:
    return bool(re.match(r"Test[A-Z_]|Benchmark[A-Z_]" if lang == "go" else r"test", f.name)) and lang in ("go", "py")


def _truth(nodes: list[Node] | None) -> str | None:
    """true or false if the list only returns or assigns that literal, with what it is given to."""
    if nodes and len(nodes) == 1 and nodes[0].head and nodes[0].head[-1].lower() in ("true", "false") and not nodes[0].blocks:
        h = nodes[0].head
        if h[0] == "return" and len(h) == 2 or len(h) >= 3 and h[-2] == "=":
            return " ".join(h[:-1]) + "|" + h[-1].lower()
    return None


def branches(u: Unit) -> Iterator[Finding]:
    for n, _, siblings, i in walk(u.top):
        if n.kind == "if":
            then, other = n.block("then"), n.block("else")
            if other and then and body_key(then) == body_key(other):
                yield n.line, "control_flow_merge", "both branches do the same"
            a = _truth(then)
            b = _truth(other) if other is not None else (_truth(siblings[i + 1 : i + 2]) if i + 1 < len(siblings) else None)
            if a and b and a.split("|")[0] == b.split("|")[0] and a != b:
                before = siblings[i - 1] if i else None
                in_run = before is not None and before.kind == "if" and _truth(before.block("then")) == a
                if not in_run or other is not None:
                    yield n.line, "boolean_ceremony", "the condition itself is the value"
        if n.kind == "switch":
            for (la, a), (_, b) in zip(n.blocks, n.blocks[1:], strict=False):
                if a and body_key(a) == body_key(b):
                    yield a[0].line, "control_flow_merge", f"{la} does the same as the next case"
            labels = {label.removeprefix("case ") for label, _ in n.blocks}
            fallback = n.block("default")
            if {"true", "false"} <= labels and fallback is not None and not (len(fallback) == 1 and fallback[0].head[:2] == ["panic", "("]):
                yield n.line, "redundant_default", "true and false are both covered"
            seen: set[str] = set()
            for label, _ in n.blocks:
                for one in label.removeprefix("case ").split(" , "):
                    if one in seen and one != "default" and u.lang != "go":  # Go: see facts
                        yield n.line, "unreachable_case", f"{one} was matched before"
                    seen.add(one)
        if n.kind == "if" and (not i or _guard(siblings[i - 1]) is None or _guard(siblings[i - 1]) != _guard(n)):
            g, j = _guard(n), i
            while g and j < len(siblings) and _guard(siblings[j]) == g:
                j += 1
            if g and (j - i >= 2 or j - i == 1) and j < len(siblings) and siblings[j].kind == "return" and siblings[j].key() == g:
                yield n.line, "control_flow_merge", f"{j - i} guards end like what follows them"


def _guard(n: Node) -> str | None:
    """The return of an if that does nothing else."""
    then = n.block("then") if n.kind == "if" and n.block("else") is None else None
    return then[0].key() if then and len(then) == 1 and then[0].kind == "return" else None


def pyramids(u: Unit) -> Iterator[Finding]:
    for f in u.funcs:
        if f.results or not f.body:
            continue
        n, depth = f.body[-1], 0
        while n.kind == "if" and n.block("else") is None:
            depth += 1
            inner = n.block("then")
            if len(inner or []) != 1:
                break
            n = inner[0]
        if depth >= 2:
            yield f.body[-1].line, "control_flow_pyramid", f"{depth} ifs are nested as the last statement"


def _tokens(nodes: list[Node]) -> list[str]:
    out = []
    for n, _, _, _ in walk(nodes):
        out += n.head
    return out


def aliases(u: Unit) -> Iterator[Finding]:
    for f in u.funcs:
        uses = Counter(_tokens(f.body))
        for n, _, siblings, i in walk(f.body):
            h = n.head
            at = 1 if h[:1] in (["const"], ["let"], ["var"]) else 0
            op = h[at + 1] if len(h) > at + 1 else ""
            if op not in (":=", "=") or n.blocks or (op == "=" and u.lang == "go"):
                continue
            name, value = h[at], h[at + 2 :]
            plain = value and all(re.match(r"[A-Za-z_$][\w$]*$|\.$", x) for x in value) and value[-1] not in ("true", "false", "nil", "null", "None", "True", "False")
            nxt = siblings[i + 1] if i + 1 < len(siblings) else None
            if plain and nxt and uses[name] == 2 and name in nxt.head and "." + value[-1] != name and not (nxt.head[:1] == value[:1] and "=" in nxt.head):
                yield n.line, "temp_alias", f"{name} only stands for {''.join(value)} in the next statement"


def wrappers(u: Unit) -> Iterator[Finding]:
    for f in u.funcs:
        if len(f.body) == 1 and private(f, u.lang) and not f.decorators and not f.body[0].blocks:
            h = [x for x in f.body[0].head if x != "await"]
            if f.body[0].kind == "return":
                h = h[1:]
            names = [p for p, _ in f.params if p != "_"]
            if "(" in h and h[-1] == ")":
                at = h.index("(")
                callee, args = h[:at], [x for x in h[at + 1 : -1] if x not in (",", "...")]
                if callee and all(re.match(r"[\w$.]+$", x) for x in callee) and callee[-1] != f.name and names and args == names and f.end - f.line <= 3:
                    yield f.line, "trivial_wrapper", f"{f.name} only forwards to {''.join(callee)}"
        if set(words(f.name)) & set(GENERIC) and private(f, u.lang):
            yield f.line, "generic_naming", f"{f.name} names no role"


def sizes(u: Unit) -> Iterator[Finding]:
    if u.lines > FILE_LINES:
        yield 1, "oversized_owner_file", f"{u.lines} lines"
    passed, calls = Counter(), set()
    for n, _, _, _ in walk(u.top):
        passed.update(n.head)
        calls |= {b for a, b, c in zip(["", *n.head], n.head, n.head[1:], strict=False) if c == "(" and a not in ("function", "func", "def")}
    for f in u.funcs:
        count = statements(f.body)
        if count > STATEMENTS:
            top = sorted(((statements([n]), -i, n) for i, n in enumerate(f.body)), key=lambda x: (-x[0], -x[1]))[:3]
            largest = ", ".join(f"{c} at line {n.line}" for c, _, n in top if c > 1)
            yield f.line, "long_function", f"{f.name} has {count} statements; largest: {largest}"
        callback = u.lang != "go" and passed[f.name] > 1 and f.name not in calls
        if len(f.params) > PARAMS and not callback:
            yield f.line, "long_param_list", f"{f.name} has {len(f.params)} parameters"
        if len(f.results) > RESULTS:
            yield f.line, "long_result_list", f"{f.name} has {len(f.results)} results"


def signatures(u: Unit) -> Iterator[Finding]:
    if u.lang != "go":
        return
    # Functions handed on as values have the signature that their users want.
    fixed = {b for n, _, _, _ in walk(u.top) for a, b, c in zip(["", *n.head], n.head, [*n.head[1:], ""], strict=False) if c != "(" and a not in (".", "func")}
    for f in u.funcs:
        kinds = [r.split()[-1] for r in f.results]
        if re.match(r"Is[A-Z0-9_]", f.name) and kinds not in (["bool"], ["bool", "error"]):
            yield f.line, "predicate_signature", f"{f.name} gives no truth"
        if private(f, "go") and len(kinds) == 3 and kinds[1:] == ["bool", "error"] and kinds[0] != "bool":
            yield f.line, "optional_result_triple", f"{f.name} has value, bool and error"
        if private(f, "go") and not f.receiver and f.body and f.name not in fixed:
            used = set(_tokens(f.body))
            for p, _ in f.params:
                if p != "_" and p not in used:
                    yield f.line, "unused_private_param", f"{f.name} never uses {p}"


def shallow(nodes: list[Node]) -> Iterator[Node]:
    """All statements, without those inside function literals."""
    for n in nodes:
        yield n
        for label, b in n.blocks:
            if label != "body":
                yield from shallow(b)


def _error(tokens: list[str], kinds: dict[str, str]) -> bool:
    return len(tokens) == 1 and (bool(ERROR.match(tokens[0])) or kinds.get(tokens[0]) == "error") or tokens[:4] == ["fmt", ".", "Errorf", "("] or tokens[:3] in (["errors", ".", "New"], ["errors", ".", "Join"])


def panics(u: Unit, is_test: bool) -> Iterator[Finding]:
    """Production functions that panic with an error; function literals are left to their callers."""
    if u.lang != "go" or is_test:
        return
    for f in u.funcs:
        for n in shallow(f.body):
            args = group(n.head[1:])[0] if n.head[:2] == ["panic", "("] else []
            if len(args) == 1 and _error(args[0], dict(f.params)):
                yield n.line, "prod_must_panic", f"{f.name} panics with the error {''.join(args[0])}"


def go_ceremonies(u: Unit, is_test: bool) -> Iterator[Finding]:
    if u.lang != "go":
        return
    for n, path, siblings, i in walk(u.top):
        body = n.block("then") or []
        if n.kind == "if" and len(body) == 1 and n.block("else") is None:
            h, b = n.head[1:], body[0].head
            if h[:2] == ["len", "("] and h[-2:] in ([">", "0"], ["!=", "0"]):
                source = h[2 : h.index(")")]
                if b[1:4] == ["=", "append", "("] and b[-2] == "..." and b[-2 - len(source) : -2] == source and not body[0].blocks:
                    yield n.line, "append_ceremony", "append of nothing does nothing"
                if body[0].kind == "for" and "range" in b and b[b.index("range") + 1 :] == source:
                    yield n.line, "range_ceremony", "range over nothing does nothing"
            if h[-2:] == ["!=", "nil"] and body[0].kind == "for" and "range" in b and b[b.index("range") + 1 :] == h[:-2]:
                yield n.line, "range_ceremony", "range over nil does nothing"
        if is_test and i and n.head[:2] == ["panic", "("] and siblings[i - 1].head[:4] in (["t", ".", "Fatal", "("], ["t", ".", "Fatalf", "("]):
            yield n.line, "test_fatal_panic", "never reached"
    for f in u.funcs:
        seen: dict[str, int] = {}
        for n, _, _, _ in walk(f.body):
            h = n.head
            if len(h) > 1 and h[1] in ("=", ":="):
                for k in [k for k in seen if h[0] in k.split()]:
                    del seen[k]
            for at in (j for j, x in enumerate(h) if x in ("TrimSpace", "ToLower", "ToUpper") and h[j + 1 : j + 2] == ["("]):
                depth, j = 0, at + 1
                while j < len(h):
                    depth += (h[j] == "(") - (h[j] == ")")
                    if not depth:
                        break
                    j += 1
                call = " ".join(h[at : j + 1])
                seen[call] = seen.get(call, 0) + 1
                if seen[call] == 2:
                    yield n.line, "normalization_ceremony", f"{call} was computed before"


def loops(u: Unit, is_test: bool) -> Iterator[Finding]:
    if u.lang != "go":
        return
    for n, path, _, _ in walk(u.top):
        fors = [p for p in path if p.kind == "for"]
        if not fors:
            continue
        loop = fors[-1]
        bound = {x for x in loop.head[1 : loop.head.index("range")] if re.match(r"\w", x)} if "range" in loop.head else {loop.head[1]} if len(loop.head) > 1 else set()
        for x, _, _, _ in walk(loop.block("then") or []):
            if len(x.head) > 1 and x.head[1] in ("=", ":=", "+="):
                bound.add(x.head[0])
        h = n.head
        free = lambda tokens: not bound & set(tokens)  # noqa: B023,E731
        for j, x in enumerate(h):
            if j < 2 or h[j - 1] != "." or h[j + 1 : j + 2] != ["("]:
                continue
            owner, parts = h[j - 2], group(h[j + 1 :])[0]
            args = [t for p in parts for t in p]
            if owner == "slices" and x in MEMBERSHIP and len(parts) >= 2 and free(parts[0]):
                yield n.line, "loop_membership_scan", f"slices.{x} scans the same collection in every round"
            if x in SORTS.get(owner, ()) and parts and free(args):
                yield n.line, "loop_sort", f"{x} sorts the same in every round"
            network = x in NETWORK and owner == "http" or x in NETWORK | {"Do"} and re.search(r"(?i)client$", owner)
            database = x in DATABASE and re.search(r"(?i)(?:^|_)(?:db|tx|conn|stmt)$|DB$", owner)
            if (network or database) and not free(args) and not is_test:
                yield n.line, "loop_external_call", f"{x} is called for every item"
            if x in COMPILES.get(owner, ()) and free(args):
                yield n.line, "loop_invariant_work", f"{owner}.{x} does the same in every round"
        if n.kind == "for" and "range" in h and "range" in loop.head:
            inner, outer = h[h.index("range") + 1 :], loop.head[loop.head.index("range") + 1 :]
            body = n.block("then") or []
            if inner == outer and inner:
                names = {x for x in h[1 : h.index("range")] if re.match(r"[a-z]", x)}
                if any(c.kind == "if" and names & set(c.head) and bound & set(c.head) for c, _, _, _ in walk(body)):
                    yield n.line, "pairwise_comparison_loop", "every item is compared with every other one"
            elif free(inner) and len(body) <= 4 and any(c.kind == "if" and "==" in c.head for c in body) and any(c.head == ["break"] for c, _, _, _ in walk(body)):
                yield n.line, "nested_lookup_loop", "a lookup by scanning, for every item"


def simplifications(u: Unit) -> Iterator[Finding]:
    """Three points in one function; guards that come after work."""
    for f in u.funcs:
        points = 0
        for n, _, siblings, i in walk(f.body):
            if n.kind == "if":
                points += "!" in n.head and "==" in n.head
                points += any(n.head[j : j + 2] in (["==", "true"], ["==", "false"], ["!=", "true"], ["!=", "false"]) for j in range(len(n.head)))
                last = (n.block("then") or [None])[-1]
                points += n.block("else") is not None and last is not None and last.kind == "return"
        if points >= 3:
            yield f.line, "complexity_simplification", f"{f.name} has {points} places to simplify"
        names = {p for p, _ in f.params}
        total = late = 0
        worked = False
        for n in f.body:
            if n.kind == "if" and names & set(n.head) and (n.block("then") or [None])[-1] is not None and n.block("then")[-1].kind == "return":
                total += 1
                late += worked
            elif "(" in n.head:
                worked = True
        if total >= 3 and late >= 2:
            yield f.line, "guard_complexity", f"{late} of {total} checks of inputs come after work"


def tests(u: Unit, is_test: bool, text: str) -> Iterator[Finding]:
    if not is_test:
        return
    faked = FAKES.search(text)
    for n, _, _, _ in walk(u.top):
        line = " ".join(n.head)
        if SLEEPS.search(line) and not faked:
            yield n.line, "test_sleep", "a test waits for real time"
        if u.lang == "ts" and re.match(r"(?:(?:it|test|describe) \. only|fit|fdescribe) \(", line):
            yield n.line, "test_focused", "only this test runs"
        if u.lang == "go" and re.match(r"\w+ := \[ \] struct ", line) and line.count("{") - 1 > 10 and not re.search(r"\b(?:name|desc|description)\b", line):
            yield n.line, "table_test_grouping", "more than 10 cases without a name"
    helpers = {f.name: f for f in u.funcs if not f.receiver}
    for f in u.funcs:
        if test_func(f, u.lang):
            body = " ".join(_tokens(f.body))
            if u.lang == "go" and f.name.startswith("Test"):
                t = f.params[0][0] if f.params else "t"
                skipped = f.body and f.body[0].head[:3] == [t, ".", "Skip"]
                handed_on = re.search(rf"[(,{{=] {re.escape(t)} [,)}}]", body)  # to a helper that may fail the test
                if not skipped and not handed_on and not ASSERTS.search(body.replace(f"{t} .", "t .")):
                    yield f.line, "test_no_assertion", f"{f.name} cannot fail"
                yield from _parallel(f, t, helpers)
            checks = [n for n, _, _, _ in walk(f.body) if n.head[:1] == ["assert"]]
            if checks and all(not re.search(r"[A-Za-z_]", re.sub(r"'[^']*'|\"[^\"]*\"|\b(?:assert|True|False|None|in|not|is|and|or)\b", "", " ".join(n.head))) for n in checks):
                yield f.line, "const_value_test", f"{f.name} only compares fixed values"


def parallel_calls(f: Func, t: str, helpers: dict[str, Func], visiting: frozenset[str] = frozenset()) -> int:
    """How often a test calls Parallel on its ``t``, also through helpers it hands ``t`` to; recursion counts nothing."""
    total = 0
    for n in shallow(f.body):
        h = n.head
        for j, x in enumerate(h):
            if h[j : j + 4] == [t, ".", "Parallel", "("]:
                total += 1
            elif x in helpers and h[j + 1 : j + 2] == ["("] and (not j or h[j - 1] != ".") and x not in visiting:
                for i, arg in enumerate(group(h[j + 1 :])[0]):
                    if arg == [t] and i < len(helpers[x].params):
                        total += parallel_calls(helpers[x], helpers[x].params[i][0], helpers, visiting | {x})
    return total


def _parallel(f: Func, t: str, helpers: dict[str, Func]) -> Iterator[Finding]:
    calls = parallel_calls(f, t, helpers, frozenset([f.name]))
    marks = [l[len(SERIAL) :].strip() for l in f.doc.split("\n") if re.match(SERIAL + r"(?:\s|$)", l)]
    if calls > 1 or not calls and not marks:
        yield f.line, "test_not_parallel", f"{f.name} calls Parallel {calls} times"
    elif marks and calls:
        yield f.line, "test_not_parallel", f"{f.name} runs in parallel in spite of its mark"
    elif marks and not marks[0]:
        yield f.line, "test_not_parallel", f"{f.name} does not say why it runs alone"


def contracts(u: Unit) -> Iterator[Finding]:
    """Guarantees in comments that cannot be read: a parameter (or a field of one), == or !=, and a constant."""
    for f in u.funcs if u.lang == "go" else []:
        names = {p for p, _ in f.params} | {f.own} - {""}
        for line in f.doc.split("\n"):
            if line.startswith(ENSURES) and contract(line, names) is None:
                yield f.line, "invalid_contract", f"the contract of {f.name} cannot be read: {line[len(ENSURES):].strip()}"


def contract(line: str, names: set[str]) -> tuple[str, str, str] | None:
    """(name or name.field, == or !=, constant) of a line that begins with the mark, or None."""
    m = re.match(r"\s*(\w+)((?:\s*\.\s*\w+)*)\s*(!=|==)\s*(nil|true|false|[+-]?\d+|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\.)')\s*$", line[len(ENSURES) :])
    return (m[1] + re.sub(r"\s", "", m[2]), m[3], m[4]) if m and m[1] in names else None


def declarations(u: Unit) -> Iterator[Finding]:
    if u.lang != "go":
        return
    run: list[Node] = []
    for n in [*u.top, Node("end", ["end"], 0, 0)]:
        kind = n.head[0] if n.head[0] in ("const", "var", "type") and n.head[1:2] not in ([], ["("]) else ""
        if run and (kind != run[0].head[0] or n.line > run[-1].end + 1):
            yield from _declared(run[0].line, run[0].head[0], [x.head[1] for x in run])
            run = []
        if kind:
            run.append(n)
        if n.head[:2] in (["const", "("], ["var", "("]):
            names = [x for i, x in enumerate(n.head[2:-1], 2) if n.head[i + 1 : i + 2] == ["="] and re.match(r"[A-Za-z_]", x)]
            yield from _declared(n.line, n.head[0], names)


def _declared(line: int, kind: str, names: list[str]) -> Iterator[Finding]:
    if len(names) > RUN:
        yield line, f"{kind}_grouping", f"{len(names)} {kind} declarations in a row"
    if kind == "const" and len(names) >= 6:
        prefixes = Counter(words(x)[0] for x in names if len(words(x)) > 1)
        mixed = sorted(p for p, c in prefixes.items() if c >= 2)
        if len(mixed) >= 3:
            yield line, "mixed_const_prefixes", "const declarations mix " + ", ".join(mixed)


def comments(u: Unit, is_test: bool) -> Iterator[Finding]:
    for f in u.funcs:
        said = [w for w in re.split(r"[\W_]+", f.doc.lower()) if w and w not in NOISE]
        named = words(f.name)
        stems = [{w, re.sub("s$", "", w), re.sub("ed$", "", w), re.sub("ing$", "", w)} for w in said]
        if said and private(f, u.lang) and len(said) == len(named) <= COMMENT_WORDS and all(any(n in s for s in stems) for n in named) and all(s & set(named) for s in stems):
            yield f.line, "comment_noise", f"the comment only repeats {f.name}"
        linters = {x for l in f.doc.split("\n") if l.startswith("nolint:") for x in l.split()[0][len("nolint:") :].split(",")}
        if linters & COMPLEXITY_LINTERS and not is_test and not any(n.kind in ("if", "for", "switch", "while") for n, _, _, _ in walk(f.body)):
            yield f.line, "stale_complexity_suppression", f"{f.name} decides nothing"
    for n, _, siblings, i in walk(u.top):
        if n.kind == "try":
            for label, b in n.blocks:
                if label.startswith(("catch", "except")) and (not b or body_key(b) in ("pass", "continue")):
                    yield n.line, "swallowed_error", "the error is dropped"
        if u.lang == "go" and n.head[:2] == ["_", "="] and n.head[-1:] == [")"]:
            yield n.line, "swallowed_error", "the result is dropped"
        if u.lang == "go" and n.kind == "if" and n.head[1:] == ["err", "!=", "nil"] and not n.block("then"):
            yield n.line, "swallowed_error", "the error is dropped"


def calls_of(u: Unit) -> dict[str, list[list[list[str]]]]:
    """Arguments of the plain calls in a file, by name."""
    out: dict[str, list[list[list[str]]]] = {}
    for n, _, _, _ in walk(u.top):
        h = n.head if n.head[:1] != ["func"] else []
        for i in range(len(h) - 1):
            if h[i + 1] == "(" and re.match(r"[A-Za-z_]\w*$", h[i]) and (not i or h[i - 1] not in (".", "func", "function", "def")):
                out.setdefault(h[i], []).append(group(h[i + 1 :])[0])
    return out


def whole_file(u: Unit, is_test: bool) -> Iterator[Finding]:
    """Rules on how the declarations of one file use each other."""
    if u.lang == "py":
        return
    calls = calls_of(u)
    names = Counter(_tokens(u.top))
    for f in u.funcs:
        if not private(f, u.lang) or f.receiver:
            continue
        own = calls.get(f.name, [])
        for i, (p, kind) in enumerate(f.params):
            given = [a[i] for a in own if len(a) > i]
            if u.lang == "go" and kind == "bool" and any(g in (["true"], ["false"]) for g in given):
                yield f.line, "bool_mode_param", f"{p} of {f.name} is given a literal"
            if u.lang == "go" and len(given) >= 2 and len({" ".join(g) for g in given}) == 1 and given[0] in (["nil"], ["0"], ['""'], ["false"]):
                yield f.line, "api_overkill", f"{p} of {f.name} is always {given[0][0]}"
        if u.lang == "go" and f.name.startswith("new") and f.params and f.params[-1][1].startswith("...") and "ption" in f.params[-1][1] and 1 <= len(own) <= 2:
            yield f.line, "api_overkill", f"{f.name} takes options but has {len(own)} uses"
        if len(own) == 1 and names[f.name] == 2 and not is_test:
            yield f.line, "split_helper_candidate", f"{f.name} is used once"
    if u.lang != "go":
        return
    methods: dict[str, dict[str, Func]] = {}
    for f in u.funcs:
        if f.receiver:
            methods.setdefault(f.receiver.lstrip("*"), {})[f.name] = f
    for n in u.top:
        h = n.head
        if h[:1] != ["type"] or len(h) < 4:
            continue
        name, kind, body = h[1], h[2], h[4:-1]
        if kind == "struct" and name[:1].islower() and re.search(r"(?i)(result|response|outcome)$", name) and name not in methods:
            if len(body) == 4 and {body[0], body[2]} & {"ok", "err", "found"} and any(private(f, "go") and any(name in r for r in f.results) for f in u.funcs):
                yield n.line, "result_wrapper", f"{name} only carries two results"
        if kind == "interface" and name[:1].islower():
            wanted = [x for i, x in enumerate(body) if body[i + 1 : i + 2] == ["("] and re.match(r"[A-Za-z_]", x)]
            have = [r for r, m in methods.items() if wanted and set(wanted) <= set(m)]
            if any(w[:1].islower() for w in wanted) and len(have) == 1:
                yield n.line, "abstraction_overkill", f"{name} has one implementation, {have[0]}"
    for r, m in methods.items():
        if {"MarshalJSON", "MarshalText"} <= set(m) and all("String" in _tokens(m[k].body) for k in ("MarshalJSON", "MarshalText")):
            yield m["MarshalJSON"].line, "serialization_ceremony", f"{r} needs only MarshalText"
    for f in u.funcs:
        inside: set[str] = set()
        for n, _, _, _ in walk(f.body):
            h = n.head
            for i in range(len(h) - 4):
                if h[i : i + 4] == ["errors", ".", "Is", "("] and set(h[i + 4 :]) & inside:
                    yield n.line, "sentinel_error_break", "an error ends a callback and is dropped"
            if "func" in h:
                inside |= {h[i + 1] for i in range(h.index("func"), len(h) - 1) if h[i] == "return" and h[i + 1].startswith("err") and h[i + 1] != "err"}
            if is_test and len(h) > 3 and h[1:4] == ["=", "func", "("] and h[0] not in {x for m, _, _, _ in walk(f.body) if m.head[1:2] == [":="] for x in m.head[:1]} and h[0] not in {p for p, _ in f.params}:
                yield n.line, "test_global_func_stub", f"{h[0]} is replaced for all tests"


def all_rules(u: Unit, is_test: bool, text: str) -> list[Finding]:
    out: list[Finding] = []
    for rule in (branches, pyramids, aliases, wrappers, sizes, signatures, simplifications, declarations, contracts):
        out += rule(u)
    for rule in (panics, go_ceremonies, loops, comments, whole_file):
        out += rule(u, is_test)
    out += tests(u, is_test, text)
    return sorted(set(out))
