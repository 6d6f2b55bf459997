"""Small sources in the three languages, for the queries on what the front ends read from a text."""

from __future__ import annotations

SOURCES: list[tuple[str, str, bool, str]] = [
    ("a.go", "go", False, """
package a

import (
	"fmt"
	other "m/lib/io"
)

// Limit bounds a load.
const Limit = 3

type Store interface {
	Load(k string) (int, error)
	close()
}

type disk struct {
	*Base
	size int
}

// Load reads a key.
func (d *disk) Load(k string) (int, error) {
	n, err := other.Read(k)
	if err != nil {
		return 0, fmt.Errorf("load %s", k)
	}
	d.size += n
	return n, nil
}

func Pick[T any](items []T, at int) T {
	return items[at]
}

func ready(n int) bool {
	if n > Limit {
		return true
	}
	return true
}

func start(n int) {
	go watch(n)
	ready(n)
}
"""),
    ("a_test.go", "go", True, """
package a

import "testing"

//strataloom:serial changes the clock
func TestLoad(t *testing.T) {
	writeFile(t, "a.txt", "sixteen bytes or more")
	check(t, load(t))
}
"""),
    ("b.py", "py", False, """
class Reader(Base, io.Source):
    def read(self, path):
        return self.open(path).text


def load(path, limit=3):
    \"\"\"Loads a path.\"\"\"
    try:
        rows = fetch(path)
    except ValueError:
        pass
    if limit is None:
        raise KeyError(path)
    return [r for r in rows if r.size < limit]
"""),
    ("c.ts", "ts", False, """
export class Sender extends Base {
}

export function send(to: string, n: number): boolean {
  for (const part of split(to)) {
    post(part, n);
  }
  return false;
}

const twice = (x: number): number => {
  return x * 2;
};
"""),
]
SOURCES = [(n, lang, test, text.removeprefix("\n")) for n, lang, test, text in SOURCES]

#: Functions of which some do the same: under other names, with other type parameters, or not quite.
ALIKE: list[tuple[str, str]] = [
    ("first", "func first(a int, b int) int {\n\tc := scale(a)\n\tif c > b {\n\t\treturn c\n\t}\n\treturn limit\n}\n"),
    ("renamed", "func renamed(x int, y int) int {\n\tz := scale(x)\n\tif z > y {\n\t\treturn z\n\t}\n\treturn limit // the most\n}\n"),
    ("other_call", "func other_call(a int, b int) int {\n\tc := shift(a)\n\tif c > b {\n\t\treturn c\n\t}\n\treturn limit\n}\n"),
    ("other_type", "func other_type(a int64, b int) int {\n\tc := scale(a)\n\tif c > b {\n\t\treturn c\n\t}\n\treturn limit\n}\n"),
    ("swapped", "func swapped(a int, b int) int {\n\tc := scale(b)\n\tif c > a {\n\t\treturn c\n\t}\n\treturn limit\n}\n"),
    ("generic", "func generic[T any](a []T, b int) T {\n\treturn a[b]\n}\n"),
    ("generic_renamed", "func generic_renamed[V any](list []V, at int) V {\n\treturn list[at]\n}\n"),
    ("not_generic", "func not_generic(list []V, at int) V {\n\treturn list[at]\n}\n"),
]
#: Texts by canonical form (every name and literal erased) and by fingerprint (only local names erased).
FORMS: list[tuple[str, str]] = [
    ("one", "x := load(a); use(x, 1) // c"),
    ("renamed", "y := load(a)\nuse(y, 1)"),
    ("other_call", "x := read(a); use(x, 1)"),
    ("other_number", "x := load(a); use(x, 2)"),
]


#: What the front ends must read from them: query -> (columns, rows).
EXPECTED: dict[str, tuple[str, list[tuple]]] = {
    "frontend_functions": (
        "src, line, end_line, name, receiver, params, results, statements, gives, exported",
        [
            ("a.go", 22, 29, "Load", "*disk", 1, 2, 5, "mixed", True),
            ("a.go", 31, 33, "Pick", "", 2, 1, 1, "mixed", True),
            ("a.go", 35, 40, "ready", "", 1, 1, 3, "always true", False),
            ("a.go", 42, 45, "start", "", 1, 0, 2, "nothing", False),
            ("a_test.go", 6, 9, "TestLoad", "", 1, 0, 2, "nothing", True),
            ("b.py", 2, 3, "read", "Reader", 1, 1, 1, "mixed", True),
            ("b.py", 6, 14, "load", "", 2, 1, 6, "mixed", True),
            ("c.ts", 4, 9, "send", "", 2, 1, 3, "always false", True),
            ("c.ts", 11, 13, "twice", "", 1, 1, 1, "mixed", False),
        ],
    ),
    "frontend_calls": (
        "src, caller, callee",
        [
            ("a.go", "Load", "Errorf"),
            ("a.go", "Load", "Read"),
            ("a.go", "start", "ready"),
            ("a.go", "start", "watch"),
            ("a_test.go", "TestLoad", "check"),
            ("a_test.go", "TestLoad", "load"),
            ("a_test.go", "TestLoad", "writeFile"),
            ("b.py", "load", "KeyError"),
            ("b.py", "load", "fetch"),
            ("b.py", "read", "open"),
            ("c.ts", "send", "post"),
            ("c.ts", "send", "split"),
        ],
    ),
    "frontend_uses": (
        "src, owner, name, member",
        [
            ("a.go", "Pick", "at", False),
            ("a.go", "Pick", "items", False),
            ("a.go", "disk.Load", "Errorf", True),
            ("a.go", "disk.Load", "Read", True),
            ("a.go", "disk.Load", "d", False),
            ("a.go", "disk.Load", "err", False),
            ("a.go", "disk.Load", "fmt", False),
            ("a.go", "disk.Load", "k", False),
            ("a.go", "disk.Load", "n", False),
            ("a.go", "disk.Load", "nil", False),
            ("a.go", "disk.Load", "other", False),
            ("a.go", "disk.Load", "size", True),
            ("a.go", "ready", "Limit", False),
            ("a.go", "ready", "n", False),
            ("a.go", "ready", "true", False),
            ("a.go", "start", "n", False),
            ("a.go", "start", "ready", False),
            ("a.go", "start", "watch", False),
            ("a_test.go", "TestLoad", "check", False),
            ("a_test.go", "TestLoad", "load", False),
            ("a_test.go", "TestLoad", "t", False),
            ("a_test.go", "TestLoad", "writeFile", False),
            ("b.py", "Reader.read", "open", True),
            ("b.py", "Reader.read", "path", False),
            ("b.py", "Reader.read", "self", False),
            ("b.py", "Reader.read", "text", True),
            ("b.py", "load", "KeyError", False),
            ("b.py", "load", "fetch", False),
            ("b.py", "load", "limit", False),
            ("b.py", "load", "path", False),
            ("b.py", "load", "r", False),
            ("b.py", "load", "rows", False),
            ("b.py", "load", "size", True),
            ("c.ts", "send", "false", False),
            ("c.ts", "send", "n", False),
            ("c.ts", "send", "part", False),
            ("c.ts", "send", "post", False),
            ("c.ts", "send", "split", False),
            ("c.ts", "send", "to", False),
            ("c.ts", "twice", "x", False),
        ],
    ),
    "frontend_types": (
        "src, type, line, embeds",
        [
            ("a.go", "disk", 16, "Base"),
            ("b.py", "Reader", 1, "Base"),
            ("b.py", "Reader", 1, "Source"),
            ("c.ts", "Sender", 1, "Base"),
        ],
    ),
    "frontend_imports": (
        "src, imported",
        [
            ("a.go", "fmt"),
            ("a.go", "m/lib/io"),
            ("a_test.go", "testing"),
        ],
    ),
    "frontend_interfaces": (
        "src, interface, method",
        [
            ("a.go", "Store", "Load"),
            ("a.go", "Store", "close"),
        ],
    ),
    "frontend_exports": (
        "src, signature",
        [
            ("a.go", "Pick([]T,int)(T)"),
            ("a.go", "const Limit = 3"),
            ("a.go", "disk.Load(string)(int,error)"),
            ("a.go", "type Store interface { Load ( k string ) ( int , error ) close ( ) }"),
            ("a_test.go", "TestLoad(*testing.T)()"),
            ("b.py", "Reader.read()(value)"),
            ("b.py", "load(,)(value)"),
            ("c.ts", "send(string,number)(boolean)"),
        ],
    ),
    "frontend_tests": (
        "src, name, line, end_line, calls",
        [
            ("a_test.go", "TestLoad", 6, 9, "check load writeFile"),
        ],
    ),
    "frontend_fixtures": (
        "src, line, literal",
        [
            ("a_test.go", 7, "\"sixteen bytes or more\""),
        ],
    ),
    "review_items": (
        "src, item, line, name",
        [
            ("a.go", "comment", 22, "disk.Load"),
            ("a.go", "helper", 35, "ready"),
            ("a_test.go", "serial", 6, "TestLoad"),
            ("a_test.go", "test", 6, "TestLoad"),
            ("b.py", "comment", 6, "load"),
            ("b.py", "error", 8, ""),
        ],
    ),
    "effect_union": (
        "v, bits",
        [
            ("a.go::Load", 7),
            ("a.go::Pick", 0),
            ("a.go::ready", 4),
            ("a.go::start", 21),
            ("a_test.go::TestLoad", 1),
            ("b.py::load", 9),
            ("b.py::read", 1),
            ("c.ts::send", 1),
            ("c.ts::twice", 0),
        ],
    ),
    "behaviour_keys": (
        "src, same_as",
        [
            ("first", "first"),
            ("generic", "generic"),
            ("generic_renamed", "generic"),
            ("not_generic", "not_generic"),
            ("other_call", "other_call"),
            ("other_type", "other_type"),
            ("renamed", "first"),
            ("swapped", "swapped"),
        ],
    ),
    "canonical_classes": (
        "src, tokens, form_of, fingerprint_of",
        [
            ("one", 12, "one", "one"),
            ("other_call", 12, "one", "other_call"),
            ("other_number", 12, "other_number", "other_number"),
            ("renamed", 12, "one", "one"),
        ],
    ),
    "interface_implementations": (
        "interface, type, alone",
        [
            ("shape", "square", True),
        ],
    ),
}
