"""Source texts to relations: functions, findings of the per-file rules, canonical keys. Arrow batches in, rows out."""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.frontends import facts, rules
from strataloom.frontends.syntax import Func, Node, Unit, group, parse, scan, statements, walk

KEYWORDS = set(
    "func return if else for range switch case default go defer select break continue goto var const type struct interface map chan package import "
    "function let class new throw try catch finally while do in of await async export extends this typeof void delete yield "
    "def elif except raise with as pass lambda not and or is None True False global nonlocal assert del from match".split()
)


def canonical_tokens(text: str, keep: set[str] = frozenset()) -> list[str]:
    """Tokens without comments and semicolons; identifiers numbered by first occurrence, literals by their digest."""
    out, names = [], {}
    for t in scan(text):
        if t.kind in ("comment", "nl") or t.text == ";":
            continue
        if t.kind == "id" and t.text not in KEYWORDS and t.text not in keep:
            out.append(names.setdefault(t.text, f"id{len(names)}"))
        elif t.kind in ("num", "str"):
            kind = "number" if t.kind == "num" or t.text[:1] == "'" else "string"
            out.append(f"{kind}:{hashlib.sha256(t.text.encode('utf-8', 'surrogatepass')).hexdigest()[:8]}")
        else:
            out.append(t.text)
    return out


def rename_fingerprint(text: str) -> str:
    """Digest of the tokens with only local bindings erased: names that are declared or assigned inside."""
    toks = [t for t in scan(text) if t.kind not in ("comment", "nl") and t.text != ";"]
    local: set[str] = set()
    for i, t in enumerate(toks):
        j = i - 1
        while t.text in (":=", "=") and j >= 0 and toks[j].kind == "id" and (not j or toks[j - 1].text != "."):
            local.add(toks[j].text)
            j = j - 2 if j > 1 and toks[j - 1].text == "," else -1
    local -= KEYWORDS
    names: dict[str, str] = {}
    body = [names.setdefault(t.text, f"v{len(names)}") if t.text in local else t.text for t in toks]
    return hashlib.sha256("\0".join(body).encode("utf-8", "surrogatepass")).hexdigest()


def local_names(f: Func) -> set[str]:
    """Parameters, the receiver, and what the body declares."""
    out = {p for p, _ in f.params} | {f.own} - {""}
    for n, _, _, _ in walk(f.body):
        h = n.head
        for i, x in enumerate(h):
            if x == ":=" or x in ("in", "of") and h[:1] == ["for"]:
                out |= {y for y in h[:i] if (y[:1].isalpha() or y[:1] == "_") and y not in KEYWORDS}
            if x in ("const", "let", "var") and i + 1 < len(h):
                out.add(h[i + 1])
        if h[1:2] == ["="] and n.kind == "simple":
            out.add(h[0])
    return out


def type_key(kind: str, generics: dict[str, str]) -> str:
    """A type with the type parameters of its function numbered, and without blanks."""
    return re.sub(r"[A-Za-z_]\w*", lambda m: generics.get(m[0], m[0]), re.sub(r"\s+", "", kind))


def behaviour_key(f: Func) -> str:
    """What a function does, whatever it and its own names are called: parameters numbered, locals by first use; whatever
    lies outside (callees, globals, fields, constants) as it is."""
    names = {p: f"p{i}" for i, (p, _) in enumerate(f.params)} | ({f.own: "p"} if f.own else {})
    local = local_names(f)
    generics = {g: f"T{i}" for i, g in enumerate(f.generics)}
    out = [",".join(type_key(k, generics) for _, k in f.params), ",".join(type_key(k, generics) for k in f.results)]
    for n, path, _, _ in walk(f.body):
        last = ""
        parts = []
        for x in n.head:
            if x in local and last != ".":
                parts.append(names.get(x) or names.setdefault(x, f"v{len(names)}"))
            else:
                parts.append(generics.get(x, x))
            last = x
        out.append(f"{len(path)}:{n.kind}:{' '.join(parts)}")
    return "\n".join(out)


#: Statements of a window; tokens of a window, of a single statement with a block, and of one beside another such (fixed
#: values, in nodes of a syntax tree; tokens stand for nodes here).
LOW, HIGH, WINDOW, STRUCTURED, BESIDE = 3, 12, 35, 15, 9


def clone_windows(f: Func) -> list[tuple[int, int, str, int, str]]:
    """(line, end, kind, weight, key) of the stretches of a function that may repeat elsewhere: windows of 3 to 12
    consecutive statements, and single statements with blocks of their own. Sizes are looked at before any key is made. In
    a key, local names are numbered by first use; all else is as it is."""
    local = local_names(f)
    out: list[tuple[int, int, str, int, str]] = []

    def size(n: Node) -> int:
        return len(n.head) + sum(size(m) for _, b in n.blocks for m in b)

    def key(nodes: list[Node]) -> str:
        names: dict[str, str] = {}
        lines = []
        for n, path, _, _ in walk(nodes):
            last, parts = "", []
            for x in n.head:
                parts.append(names.setdefault(x, f"v{len(names)}") if x in local and last != "." else x)
                last = x
            lines.append(f"{len(path)}:{n.kind}:{' '.join(parts)}")
        return hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()

    def look(nodes: list[Node]) -> None:
        sizes = [size(n) for n in nodes]
        blocked = [bool(n.blocks) for n in nodes]
        for i, n in enumerate(nodes):
            total = sum(sizes[i : i + LOW - 1])
            for w in range(LOW, min(HIGH, len(nodes) - i) + 1):
                total += sizes[i + w - 1]
                if total >= WINDOW:
                    out.append((n.line, nodes[i + w - 1].end, "window", total, key(nodes[i : i + w])))
            beside = i > 0 and blocked[i - 1] or i + 1 < len(nodes) and blocked[i + 1]
            if blocked[i] and sizes[i] >= (BESIDE if beside else STRUCTURED):
                out.append((n.line, n.end, "statement", sizes[i], key([n])))
            for _, b in n.blocks:
                look(b)

    look(f.body)
    return out


def windows(df: DataFrame, keys: list[str], text: str, lang: str) -> DataFrame:
    """(keys, name, line, end_line, kind, weight, digest) of ``clone_windows`` of every function."""
    schema = T._parse_datatype_string("name string, line int, end_line int, kind string, weight int, digest string")

    def make(row: dict) -> list[tuple]:
        try:
            u = _unit(row)
        except ValueError:
            return []
        return [(label(f), *w) for f in u.funcs for w in clone_windows(f)]

    return _each(df, keys, text, lang, [], make, schema)


def effects(f: Func) -> int:
    """Bits: 1 calls, 2 writes to fields or items, 4 returns early, 8 raises, 16 starts work elsewhere."""
    bits = 0
    for n, path, _, _ in walk(f.body):
        h = n.head
        bits |= 1 * ("(" in h)
        bits |= 2 * any(x in ("=", "+=") and i and ("." in h[:i] or "[" in h[:i]) for i, x in enumerate(h))
        bits |= 4 * (n.kind == "return" and bool(path))
        bits |= 8 * (h[:1] in (["panic"], ["raise"], ["throw"]))
        bits |= 16 * (h[:1] in (["go"], ["await"], ["defer"]))
    return bits


#: Python frames that a walk over a text may take, enough for chains of thousands of branches or operators. A text that
#: needs more counts as one that cannot be read.
DEPTH = 20_000


def _each(df: DataFrame, keys: list[str], text: str, lang: str, extra: list[str], make: Callable[[dict], list[tuple]], schema: T.StructType, too_deep: tuple[tuple, ...] = ()) -> DataFrame:
    """The rows that ``make`` gives for each text, behind its keys; ``too_deep`` for one nested beyond ``DEPTH``."""
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isin("go", "ts", "py")).select(*keys, F.col(text).alias("_text"), F.col(lang).alias("_lang"), *extra)
    out_schema = T.StructType([rows.schema[k] for k in keys] + list(schema))
    arrow = {"string": pa.string(), "integer": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), DEPTH))
        for b in batches:
            take, out = [], []
            cols = {n: b.column(n).to_pylist() for n in ("_text", "_lang", *extra)}
            for i in range(b.num_rows):
                try:
                    made = make({n: c[i] for n, c in cols.items()})
                except RecursionError:
                    made = too_deep
                take += [i] * len(made)
                out += made
            at = pa.array(take, pa.int64())
            made_cols = list(zip(*out, strict=True)) if out else [()] * len(schema)
            yield pa.RecordBatch.from_arrays(
                [b.column(k).take(at) for k in keys] + [pa.array(list(c), arrow[f.dataType.typeName()]) for c, f in zip(made_cols, schema, strict=True)], names=out_schema.names
            )

    return rows.mapInArrow(run, out_schema)


def _unit(row: dict) -> Unit:
    return parse(row["_text"], row["_lang"])


def functions(df: DataFrame, keys: list[str], text: str, lang: str) -> DataFrame:
    """One row a function of the texts that can be read."""
    schema = T._parse_datatype_string("name string, receiver string, params int, results int, statements int, line int, end_line int, digest string, effects int, gives string, exported boolean")

    def make(row: dict) -> list[tuple]:
        try:
            u = _unit(row)
        except ValueError:
            return []
        return [
            (f.name, f.receiver, len(f.params), len(f.results), statements(f.body), f.line, f.end, hashlib.sha256(behaviour_key(f).encode("utf-8", "surrogatepass")).hexdigest(), effects(f), facts.returns(f), f.exported)
            for f in u.funcs
        ]

    return _each(df, keys, text, lang, [], make, schema)


def findings(df: DataFrame, keys: list[str], text: str, lang: str, is_test: str) -> DataFrame:
    """(keys, line, kind, message) of all per-file rules; a text that cannot be read has one parse_error and no others."""
    schema = T._parse_datatype_string("line int, kind string, message string")

    def make(row: dict) -> list[tuple]:
        try:
            u = _unit(row)
        except ValueError as e:
            return [(1, "parse_error", str(e)[:200])]
        found = rules.all_rules(u, bool(row[is_test]), row["_text"])
        summaries = facts.summarise(u.funcs, u.lang)
        for f in u.funcs:
            found += facts.decided(f, u.lang, summaries)
        return sorted(set(found))

    return _each(df, keys, text, lang, [is_test], make, schema, ((1, "parse_error", "nested too deeply"),))


def calls(df: DataFrame, keys: list[str], text: str, lang: str) -> DataFrame:
    """(keys, caller, callee): the plain names that functions call."""
    schema = T._parse_datatype_string("caller string, callee string")

    def make(row: dict) -> list[tuple]:
        try:
            u = _unit(row)
        except ValueError:
            return []
        out = set()
        for f in u.funcs:
            for n, _, _, _ in walk(f.body):
                h = n.head
                out |= {(f.name, x) for i, x in enumerate(h[:-1]) if h[i + 1] == "(" and x[:1].isalpha() and x not in KEYWORDS}
        return sorted(out)

    return _each(df, keys, text, lang, [], make, schema)


def uses(df: DataFrame, keys: list[str], text: str, lang: str) -> DataFrame:
    """(keys, owner, name, member): every identifier in the body of a function, or outside of any (owner null); member tells
    that it stands behind a dot. The owner of a method is Receiver.name."""
    schema = T._parse_datatype_string("owner string, name string, member boolean")

    def make(row: dict) -> list[tuple]:
        try:
            u = _unit(row)
        except ValueError:
            return []
        out: set[tuple] = set()

        def take(owner: str | None, head: list[str]) -> None:
            for a, b in zip(["", *head], head, strict=False):
                if (b[:1].isalpha() or b[:1] == "_") and b not in KEYWORDS:
                    out.add((owner, b, a == "."))

        headers = {(f.line, f.name) for f in u.funcs}
        for f in u.funcs:
            for n, _, _, _ in walk(f.body):
                take(label(f), n.head)
        for n in u.top:
            inside = n.kind in ("func", "class") or any((n.line, x) in headers for x in n.head)
            take(None, n.head if not inside else [x for x in n.head if (n.line, x) not in headers])
            if not inside:
                for m, _, _, _ in walk([n]):
                    take(None, m.head)
        return sorted(out, key=repr)

    return _each(df, keys, text, lang, [], make, schema)


def label(f: Func) -> str:
    return f"{f.receiver.lstrip('*')}.{f.name}" if f.receiver else f.name


def interface_methods(df: DataFrame, keys: list[str], text: str, lang: str) -> DataFrame:
    """(keys, interface, method) of the interfaces that Go files declare."""
    schema = T._parse_datatype_string("interface string, method string")

    def make(row: dict) -> list[tuple]:
        try:
            u = _unit(row)
        except ValueError:
            return []
        out = []
        for n in u.top:
            h = n.head
            for i in range(len(h) - 2):
                if h[i + 1 : i + 3] == ["interface", "{"] and (h[:1] == ["type"]):
                    depth, j = 1, i + 3
                    while j < len(h) and depth:
                        depth += (h[j] in "({[") - (h[j] in ")}]")
                        if depth == 1 and h[j + 1 : j + 2] == ["("] and (h[j][:1].isalpha() or h[j][:1] == "_"):
                            out.append((h[i], h[j]))
                        j += 1
        return out

    return _each(df, keys, text, lang, [], make, schema)


_STRUCT = re.compile(r"^type\s+(\w+)(?:\[[^\]]*\])?\s+struct\s*\{(.*?)^\}", re.M | re.S)
_EMBEDDED = re.compile(r"^\s*\*?(?:\w+\.)?(\w+)\s*(?:`[^`]*`)?\s*(?://.*)?$")
_CLASS = re.compile(r"^(?:export\s+)?(?:abstract\s+)?class\s+(\w+)(?:\(([^)]*)\)|\s+extends\s+([\w.]+))?", re.M)


def types(df: DataFrame, keys: list[str], text: str, lang: str) -> DataFrame:
    """(keys, type, line, embeds): the structs and classes of a file with the types they embed or inherit from."""
    schema = T._parse_datatype_string("type string, line int, embeds string")

    def make(row: dict) -> list[tuple]:
        t, out = row["_text"], []
        if row["_lang"] == "go":
            for m in _STRUCT.finditer(t):
                own = [e[1] for e in map(_EMBEDDED.match, m[2].split("\n")) if e]
                out += [(m[1], t.count("\n", 0, m.start()) + 1, e) for e in own or [None]]
        else:
            for m in _CLASS.finditer(t):
                own = [x.strip().split(".")[-1] for x in (m[2] or m[3] or "").split(",") if x.strip() and "=" not in x]
                out += [(m[1], t.count("\n", 0, m.start()) + 1, e) for e in own or [None]]
        return out

    return _each(df, keys, text, lang, [], make, schema)


_IMPORT = re.compile(r'^import\s+(?:[\w.]+\s+)?"([^"]+)"|^\s+(?:[\w.]+\s+)?"([^"]+)"\s*$', re.M)


def imports(df: DataFrame, keys: list[str], text: str, lang: str) -> DataFrame:
    """(keys, path): the packages a Go file imports."""
    schema = T._parse_datatype_string("imported string")

    def make(row: dict) -> list[tuple]:
        t = row["_text"]
        head = t[: m.start()] if (m := re.search(r"^(?:func|type|var|const)\b", t, re.M)) else t
        return [(a or b,) for a, b in _IMPORT.findall(head)] if row["_lang"] == "go" else []

    return _each(df, keys, text, lang, [], make, schema)


def written_fixtures(df: DataFrame, keys: list[str], text: str, lang: str, least: int = 16) -> DataFrame:
    """(keys, line, literal): the literals of at least ``least`` bytes that Go code hands to writeFile."""
    schema = T._parse_datatype_string("line int, literal string")

    def make(row: dict) -> list[tuple]:
        try:
            u = _unit(row)
        except ValueError:
            return []
        out = []
        for n, _, _, _ in walk(u.top):
            for i, x in enumerate(n.head):
                if x == "writeFile" and n.head[i + 1 : i + 2] == ["("] and n.head[:1] != ["func"]:
                    out += [(n.line, a[0]) for a in group(n.head[i + 1 :])[0] if len(a) == 1 and a[0][:1] in "\"`" and len(a[0].encode("utf-8", "surrogatepass")) - 2 >= least]
        return out

    return _each(df, keys, text, lang, [], make, schema)


def function_texts(df: DataFrame, keys: list[str], text: str, lang: str, least: int = 50) -> DataFrame:
    """(keys, name, line, end_line, content): the functions of at least ``least`` tokens, comments not counted, with their
    lines."""
    schema = T._parse_datatype_string("name string, line int, end_line int, content string")

    def make(row: dict) -> list[tuple]:
        try:
            u = _unit(row)
        except ValueError:
            return []
        lines = row["_text"].split("\n")
        out = []
        for f in u.funcs:
            body = "\n".join(lines[f.line - 1 : f.end])
            if sum(t.kind not in ("comment", "nl") for t in scan(body)) >= least:
                out.append((label(f), f.line, f.end, body))
        return out

    return _each(df, keys, text, lang, [], make, schema)


def test_calls(df: DataFrame, keys: list[str], text: str, lang: str) -> DataFrame:
    """(keys, name, line, end_line, calls): the test functions of Go and Python with the names they call."""
    schema = T._parse_datatype_string("name string, line int, end_line int, calls array<string>")

    def make(row: dict) -> list[tuple]:
        try:
            u = _unit(row)
        except ValueError:
            return []
        out = []
        for f in u.funcs:
            if rules.test_func(f, u.lang):
                names = {x for n, _, _, _ in walk(f.body) for x, y in zip(n.head, n.head[1:], strict=False) if y == "(" and x[:1].isalpha() and x not in KEYWORDS}
                out.append((f.name, f.line, f.end, sorted(names)))
        return out

    return _each(df, keys, text, lang, [], make, schema)


def review_items(df: DataFrame, keys: list[str], text: str, lang: str, is_test: str) -> DataFrame:
    """(keys, item, line, name, content): what a reviewer is asked about. Items: comment (of a function), error (a dropped
    one), test, serial (the reason a test gives for running alone), helper (a function used once, with its one caller)."""
    schema = T._parse_datatype_string("item string, line int, name string, content string")

    def make(row: dict) -> list[tuple]:
        try:
            u = _unit(row)
        except ValueError:
            return []
        lines, out = row["_text"].split("\n"), []
        span = lambda a, b: "\n".join(lines[a - 1 : b])
        test = bool(row[is_test])
        for f in u.funcs:
            said = [l for l in f.doc.split("\n") if l.strip() and not re.match(r"(?:nolint|go|strataloom):", l)]
            if said:
                out.append(("comment", f.line, label(f), "\n".join(said) + "\n" + span(f.line, f.end)))
            if test and rules.test_func(f, u.lang):
                out.append(("test", f.line, f.name, span(f.line, f.end)))
                out += [("serial", f.line, f.name, l[len(rules.SERIAL) :].strip()) for l in f.doc.split("\n") if re.match(rules.SERIAL + r"\s+\S", l)]
        for line, kind, _ in rules.comments(u, test):
            if kind == "swallowed_error":
                out.append(("error", line, "", span(max(1, line - 3), line + 6)))
        for line, kind, message in rules.whole_file(u, test):
            if kind == "split_helper_candidate":
                name = message.split(" ")[0]
                f = next(f for f in u.funcs if f.name == name)
                caller = next((g for g in u.funcs if g is not f and any(name in n.head for n, _, _, _ in walk(g.body))), None)
                out.append(("helper", line, name, (span(caller.line, caller.end) + "\n\n" if caller else "") + span(f.line, f.end)))
        return out

    return _each(df, keys, text, lang, [is_test], make, schema)


def exports(df: DataFrame, keys: list[str], text: str, lang: str) -> DataFrame:
    """(keys, signature): what other packages see of a file: exported functions with the kinds of their parameters and
    results, and the declarations of exported types, constants and variables."""
    schema = T._parse_datatype_string("signature string")

    def make(row: dict) -> list[tuple]:
        try:
            u = _unit(row)
        except ValueError:
            return [(hashlib.sha256(row["_text"].encode("utf-8", "surrogatepass")).hexdigest(),)]
        out = [(f"{label(f)}({','.join(k for _, k in f.params)})({','.join(f.results)})",) for f in u.funcs if f.exported]
        out += [(" ".join(n.head),) for n in u.top if n.head[:1] in (["type"], ["const"], ["var"]) and len(n.head) > 1 and (n.head[1][:1].isupper() or n.head[1] == "(")]
        return sorted(set(out))

    return _each(df, keys, text, lang, [], make, schema)


def canonical(df: DataFrame, keys: list[str], text: str, lang: str, least: int = 50) -> DataFrame:
    """(keys, tokens, digest, fingerprint) of texts with at least ``least`` canonical tokens."""
    schema = T._parse_datatype_string("tokens int, digest string, fingerprint string")

    def make(row: dict) -> list[tuple]:
        t = canonical_tokens(row["_text"])
        return [(len(t), hashlib.sha256("\0".join(t).encode("utf-8", "surrogatepass")).hexdigest(), rename_fingerprint(row["_text"]))] if len(t) >= least else []

    return _each(df, keys, text, lang, [], make, schema)


__all__ = [
    "behaviour_key", "calls", "canonical", "canonical_tokens", "clone_windows", "effects", "exports", "findings", "function_texts", "functions", "imports", "interface_methods",
    "label", "rename_fingerprint", "review_items", "test_calls", "types", "uses", "windows", "written_fixtures",
]
