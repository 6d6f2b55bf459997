"""Small sources for every rule on source texts, with what the rules must find in them and nothing else.

A case: (name, language, is it a test, text, findings as "line kind"). Every kind has a case that breaks the rule and one
that only looks like it. Lines count from 1 in the text without its first line end.
"""

from __future__ import annotations

Case = tuple[str, str, bool, str, list[str]]
CASES: dict[str, list[Case]] = {}


def case(group: str, name: str, lang: str, text: str, *found: str, test: bool = False) -> None:
    CASES.setdefault(group, []).append((name, lang, test, text.removeprefix("\n"), list(found)))


# Branches.

case("branches", "merge_else", "go", """
package a

func Run(n int) {
	if n > 3 {
		stop(n)
	} else {
		stop(n)
	}
}
""", "4 control_flow_merge")
case("branches", "merge_cases", "go", """
package a

func Run(n int) {
	switch n {
	case 1:
		one(n)
	case 2:
		one(n)
	case 3:
		two(n)
	}
}
""", "6 control_flow_merge")
case("branches", "merge_guards", "ts", """
export function pick(a: string, b: string): number {
  if (a === b) {
    return 0;
  }
  if (a.length > 9) {
    return 0;
  }
  return 0;
}
""", "2 control_flow_merge")
case("branches", "no_merge", "py", """
def pick(a, b):
    if a == b:
        return first(a)
    else:
        return second(a)
""")
case("branches", "truth", "go", """
package a

func Ready(n int) bool {
	if n > 3 {
		return true
	}
	return false
}
""", "4 boolean_ceremony")
case("branches", "truth_assigned", "py", """
def ready(n):
    if n > 3:
        done = True
    else:
        done = False
    return use(done)
""", "2 boolean_ceremony")
case("branches", "no_truth", "go", """
package a

func Ready(n int) bool {
	if n > 3 {
		return true
	}
	return other(n)
}
""")
case("branches", "both_truths", "go", """
package a

func Name(on bool) string {
	switch on {
	case true:
		return "on"
	case false:
		return "off"
	default:
		return "?"
	}
}
""", "4 redundant_default")
case("branches", "impossible_state", "go", """
package a

func Name(on bool) string {
	switch on {
	case true:
		return "on"
	case false:
		return "off"
	default:
		panic("neither")
	}
}
""")
case("branches", "case_again", "go", """
package a

func Name(n int) string {
	switch n {
	case 1:
		return "one"
	case 2, 1:
		return "two"
	case 1:
		return "never"
	}
	return "many"
}
""", "9 unreachable_case")
case("branches", "case_by_order", "go", """
package a

func Size(n int) string {
	switch {
	case n > 10:
		return "large"
	case n > 20:
		return "never"
	case n > 5:
		return "middle"
	}
	return "small"
}
""", "7 unreachable_case")
case("branches", "cases_apart", "go", """
package a

func Size(n int) string {
	switch {
	case n > 20:
		return "large"
	case n > 10:
		return "middle"
	}
	return "small"
}
""")

# Shapes.

case("shapes", "pyramid", "go", """
package a

func Run(a, b int) {
	prepare()
	if a > 1 {
		if b > 1 {
			work(a, b)
		}
	}
}
""", "5 control_flow_pyramid")
case("shapes", "no_pyramid", "go", """
package a

func Run(a, b int) {
	if a > 1 {
		if b > 1 {
			work(a, b)
		}
		tidy(a)
	}
}
""")
case("shapes", "alias", "ts", """
export function send(conf: Conf): void {
  const t = conf.target;
  post(t);
}
""", "2 temp_alias")
case("shapes", "alias_used_twice", "ts", """
export function send(conf: Conf): void {
  const t = conf.target;
  post(t, t);
}
""")
case("shapes", "wrapper", "go", """
package a

func load(a int, b int) int { return read(a, b) }
""", "3 trivial_wrapper")
case("shapes", "no_wrapper", "go", """
package a

func load(a int, b int) int { return read(b, a) }

func Load(a int, b int) int { return read(a, b) }
""")
case("shapes", "role_less", "ts", """
function parseHelper(a: string): string {
  const parts = split(a);
  return parts[0];
}
""", "1 generic_naming")
case("shapes", "role", "ts", """
function parseHeader(a: string): string {
  const parts = split(a);
  return parts[0];
}
""")

# Sizes.

case("sizes", "long_file", "py", "x = 1\n" * 1001, "1 oversized_owner_file")
case("sizes", "file_at_limit", "py", "x = 1\n" * 1000)
case("sizes", "long_body", "go", "package a\n\nfunc Run() {\n" + "".join(f"\tstep{i}()\n" for i in range(41)) + "}\n", "3 long_function")
case("sizes", "body_at_limit", "go", "package a\n\nfunc Run() {\n" + "".join(f"\tstep{i}()\n" for i in range(40)) + "}\n")
case("sizes", "many_params", "py", """
def run(a, b, c, d, e, f, g):
    return a + b + c + d + e + f + g
""", "1 long_param_list")
case("sizes", "params_at_limit", "py", """
def run(a, b, c, d, e, f):
    return a + b + c + d + e + f
""")
case("sizes", "callback", "ts", """
export function watch(bus: Bus): void {
  bus.on("change", changed);
  bus.off("change", changed);
}
function changed(a: A, b: B, c: C, d: D, e: E, f: F, g: G): void {
  use(a, b, c, d, e, f, g);
  done(a);
}
""")
case("sizes", "many_results", "go", """
package a

func Read(n int) (int, int, int, error) {
	return n, n, n, nil
}
""", "3 long_result_list")
case("sizes", "results_at_limit", "go", """
package a

func Read(n int) (int, int, error) {
	return n, n, nil
}
""")

# Signatures.

case("signatures", "predicate", "go", """
package a

func IsReady(n int) int { return n + 1 }

func IsDone(n int) (bool, error) { return n > 1, nil }

func Island(n int) int { return n + 2 }
""", "3 predicate_signature")
case("signatures", "triple", "go", """
package a

func find(k string) (int, bool, error) { return len(k), k > "a", nil }

func Find(k string) (int, bool, error) { return len(k), k > "a", nil }

func check(k string) (bool, bool, error) { return k > "a", k > "b", nil }
""", "3 optional_result_triple")
case("signatures", "unused", "go", """
package a

func load(path string, deep bool, _ int) string { return path + ".go" }

func (s *store) load(path string, deep bool) string { return path + ".go" }
""", "3 unused_private_param")

case("signatures", "unused_by_value", "go", """
package a

var handlers = []handler{first}

func first(path string, deep bool) string { return path + ".go" }
""")

# Ceremonies.

case("ceremonies", "append_guarded", "go", """
package a

func Join(a, b []int) []int {
	if len(b) > 0 {
		a = append(a, b...)
	}
	if len(b) > 0 {
		a = append(a, 7)
	}
	return a
}
""", "4 append_ceremony")
case("ceremonies", "range_guarded", "go", """
package a

func Each(a []int) {
	if a != nil {
		for _, x := range a {
			use(x)
		}
	}
	if ready(a) {
		for _, x := range a {
			use(x)
		}
	}
}
""", "4 range_ceremony")
case("ceremonies", "error_panics", "go", """
package a

func Open(path string) file {
	f, openErr := open(path)
	if openErr != nil {
		panic(openErr)
	}
	if f == nil {
		panic(fmt.Errorf("no %s", path))
	}
	if f.old {
		panic("old file")
	}
	later(func() {
		panic(openErr)
	})
	return f
}
""", "6 prod_must_panic", "9 prod_must_panic")
case("ceremonies", "error_panics_in_tests", "go", """
package a

func open(path string) {
	if err := try(path); err != nil {
		panic(err)
	}
}
""", test=True)
case("ceremonies", "fatal_then_panic", "go", """
package a

func check(t *testing.T, n int) {
	if n > 3 {
		t.Fatalf("%d", n)
		panic("never")
	}
	if n > 2 {
		t.Log(n)
		panic("reached")
	}
}
""", "6 test_fatal_panic", test=True)
case("ceremonies", "trimmed_twice", "go", """
package a

func Clean(s string) string {
	if strings.TrimSpace(s) == "" {
		return other(s)
	}
	return strings.TrimSpace(s)
}

func Clean2(s string) string {
	if strings.TrimSpace(s) == "" {
		return other(s)
	}
	s = next(s)
	return strings.TrimSpace(s)
}
""", "7 normalization_ceremony")

# Loops.

case("loops", "membership", "go", """
package a

func Known(names []string, all []string) {
	for _, n := range names {
		if slices.Contains(all, n) {
			use(n)
		}
		if slices.Contains(others(n), n) {
			use(n)
		}
	}
}
""", "5 loop_membership_scan")
case("loops", "sorted_again", "go", """
package a

func Walk(names []string, all []string) {
	for _, n := range names {
		sort.Strings(all)
		slices.Sort(parts(n))
		use(n)
	}
}
""", "5 loop_sort")
case("loops", "calls_outside", "go", """
package a

func Fetch(client *http.Client, db *sql.DB, urls []string) {
	for _, u := range urls {
		use(http.Get(u))
		use(client.Do(u))
		use(db.Query("select 1", u))
		use(header.Get(u))
	}
}
""", "5 loop_external_call", "6 loop_external_call", "7 loop_external_call")
case("loops", "calls_outside_in_tests", "go", """
package a

func fetchAll(urls []string) {
	for _, u := range urls {
		use(http.Get(u))
	}
}
""", test=True)
case("loops", "built_again", "go", """
package a

func Match(lines []string) {
	for _, l := range lines {
		use(regexp.MustCompile("a+"), l)
		use(strings.NewReplacer("a", "b"), l)
		use(template.Must(page), l)
		use(regexp.MustCompile(l))
	}
}
""", "5 loop_invariant_work", "6 loop_invariant_work", "7 loop_invariant_work")
case("loops", "lookup", "go", """
package a

func Tie(orders []order, people []person) {
	for _, o := range orders {
		for _, p := range people {
			if p.id == o.id {
				use(o, p)
				break
			}
		}
	}
	for _, o := range orders {
		for _, p := range o.people {
			if p.id == o.id {
				use(o, p)
				break
			}
		}
	}
}
""", "5 nested_lookup_loop")
case("loops", "pairwise", "go", """
package a

func Near(points []point) {
	for _, a := range points {
		for _, b := range points {
			if a.x == b.x {
				use(a, b)
			}
		}
	}
	for _, a := range points {
		for _, b := range points {
			use(a, b)
		}
	}
}
""", "5 pairwise_comparison_loop")

# Complexity.

case("complexity", "three_points", "go", """
package a

func Run(a, b, c bool, n int) int {
	if a == true {
		n = n + 1
	}
	if b == false {
		n = n + 2
	}
	if c {
		return n
	} else {
		n = n + 3
	}
	return n
}
""", "3 complexity_simplification")
case("complexity", "two_points", "go", """
package a

func Run(a, b bool, n int) int {
	if a == true {
		n = n + 1
	}
	if b == false {
		n = n + 2
	}
	return n
}
""")
case("complexity", "late_guards", "go", """
package a

func Send(to string, n int, body string) error {
	if to == "" {
		return errTo
	}
	open(to)
	if n > 9 {
		return errCount
	}
	write(n)
	if body == "" {
		return errBody
	}
	return flush(body)
}
""", "3 guard_complexity")
case("complexity", "early_guards", "go", """
package a

func Send(to string, n int, body string) error {
	if to == "" {
		return errTo
	}
	if n > 9 {
		return errCount
	}
	if body == "" {
		return errBody
	}
	open(to)
	return flush(body, n)
}
""")

# Tests.

case("tests", "sleeps", "py", """
def test_wait(clock):
    time.sleep(1)
    assert clock.now() == ready()
""", "2 test_sleep", test=True)
case("tests", "sleeps_faked", "py", """
def test_wait(clock, monkeypatch):
    monkeypatch.setattr(time, "sleep", skip)
    time.sleep(1)
    assert clock.now() == ready()
""", test=True)
case("tests", "only_one", "ts", """
it.only("counts", () => {
  expect(count()).toBe(3);
});
""", "1 test_focused", test=True)
case("tests", "all_run", "ts", """
it("counts", () => {
  expect(count()).toBe(3);
});
""", test=True)
case("tests", "cannot_fail", "go", """
package a

func TestRun(t *testing.T) {
	t.Parallel()
	run()
}

func TestHelped(t *testing.T) {
	t.Parallel()
	check(t, run())
}

func TestLater(t *testing.T) {
	t.Skip("later")
	t.Parallel()
}
""", "3 test_no_assertion", test=True)
case("tests", "parallel", "go", """
package a

func TestAlone(t *testing.T) {
	t.Error(run())
}

func TestTwice(t *testing.T) {
	t.Parallel()
	start(t)
	t.Error(run())
}

func TestOnce(t *testing.T) {
	start(t)
	t.Error(run())
}

//strataloom:serial changes the environment
func TestMarked(t *testing.T) {
	t.Error(run())
}

//strataloom:serial
func TestNoReason(t *testing.T) {
	t.Error(run())
}

//strataloom:serial no more
func TestStale(t *testing.T) {
	t.Parallel()
	t.Error(run())
}

func start(tt *testing.T) {
	tt.Parallel()
	again(tt)
}

func again(tt *testing.T) {
	start(tt)
	tt.Log("again")
}
""", "3 test_not_parallel", "7 test_not_parallel", "24 test_not_parallel", "29 test_not_parallel", test=True)
case("tests", "stub", "go", """
package a

func TestNow(t *testing.T) {
	t.Parallel()
	now = func() int { return 1 }
	own := func() int { return 2 }
	own = func() int { return 3 }
	t.Error(run(own))
}
""", "5 test_global_func_stub", test=True)
_ROWS = "".join(f"\t\t{{{i}, {i + 1}}},\n" for i in range(11))
case("tests", "nameless_cases", "go", f"""
package a

func TestAdd(t *testing.T) {{
	t.Parallel()
	cases := []struct{{ in, want int }}{{
{_ROWS}	}}
	check(t, cases)
}}
""", "5 table_test_grouping", test=True)
case("tests", "named_cases", "go", f"""
package a

func TestAdd(t *testing.T) {{
	t.Parallel()
	cases := []struct{{ name string; in, want int }}{{
{_ROWS}	}}
	check(t, cases)
}}
""", test=True)
case("tests", "fixed_values", "py", """
def test_limit():
    assert 1 == 1


def test_value():
    assert limit() == 1
""", "1 const_value_test", test=True)

# Declarations.

_RUN = lambda kind, n, name="a", tail="= 1": "".join(f"{kind} {name}{i} {tail}\n" for i in range(n))
case("declarations", "consts", "go", "package a\n\n" + _RUN("const", 11), "3 const_grouping")
case("declarations", "vars", "go", "package a\n\n" + _RUN("var", 11), "3 var_grouping")
case("declarations", "types", "go", "package a\n\n" + _RUN("type", 11, tail="int"), "3 type_grouping")
case("declarations", "runs_at_limit", "go", "package a\n\n" + _RUN("const", 10) + "\n" + _RUN("var", 10) + "\n" + _RUN("type", 10, "b", "int"))
case("declarations", "run_with_gap", "go", "package a\n\n" + _RUN("const", 6) + "\n" + _RUN("const", 5, "b"))
case("declarations", "prefixes", "go", """
package a

const (
	fileOpen = 1
	fileShut = 2
	pathLong = 3
	pathAbs = 4
	nameUser = 5
	nameHost = 6
)
""", "3 mixed_const_prefixes")
case("declarations", "two_prefixes", "go", """
package a

const (
	fileOpen = 1
	fileShut = 2
	pathLong = 3
	pathAbs = 4
	nameUser = 5
	hostUser = 6
)
""")

# Comments and errors.

case("comments", "says_the_name", "go", """
package a

// Loads the files.
func loadFile(path string) string { return path + ".go" }

// loads files, in order of name
func loadFiles(path string) string { return path + ".go" }

// LoadFile loads file.
func LoadFile(path string) string { return path + ".go" }
""", "4 comment_noise")
case("comments", "stale_nolint", "go", """
package a

// Run runs.
//nolint:cyclop,lll // was longer once
func Run(n int) int { return n + 1 }

//nolint:gocognit
func Pick(n int) int {
	if n > 3 {
		return other(n)
	}
	return n
}

//nolint:lll
func Rest(n int) int { return n + 2 }
""", "5 stale_complexity_suppression")
case("comments", "swallowed", "py", """
def run(a):
    try:
        go(a)
    except ValueError:
        pass
    try:
        go(a)
    except ValueError as e:
        report(e)
""", "2 swallowed_error")
case("comments", "swallowed_ts", "ts", """
export function run(a: string): void {
  try {
    go(a);
  } catch (e) {
  }
  try {
    go(a);
  } catch (e) {
    report(e);
  }
}
""", "2 swallowed_error")
case("comments", "contract", "go", """
package a

//strataloom:ensures x != nil
//strataloom:ensures x.name == "a"
func ensure(x *thing) {
	if x == nil {
		fail()
	}
}

//strataloom:ensures y != nil
//strataloom:ensures x > 3
func broken(x *thing) {
	if x == nil {
		fail()
	}
}
""", "13 invalid_contract", "13 invalid_contract")

# Relations within a file.

case("relations", "bool_mode", "go", """
package a

func Run() {
	load("a", true)
	store("b", deep())
}

func load(path string, deep bool) {
	use(path)
	use(deep)
}

func store(path string, deep bool) {
	use(path)
	use(deep)
}
""", "8 bool_mode_param", "8 split_helper_candidate", "13 split_helper_candidate")
case("relations", "always_zero", "go", """
package a

func Run() {
	load("a", nil)
	load("b", nil)
	store("a", nil)
	store("b", opts())
}

func load(path string, o *options) {
	use(path)
	use(o)
}

func store(path string, o *options) {
	use(path)
	use(o)
}
""", "10 api_overkill")
case("relations", "result_struct", "go", """
package a

type fetchResult struct {
	value int
	ok bool
}

type fetchResponse struct {
	value int
	size int
}

func fetch(k string) fetchResult { return get(k + "a") }

func ask(k string) fetchResponse { return get(k + "b") }
""", "3 result_wrapper")
case("relations", "one_implementation", "go", """
package a

type store interface {
	load(k string) int
}

type cache interface {
	drop(k string) int
}

func (d *disk) load(k string) int { return d.m[k] }

func (d *disk) drop(k string) int { return d.n[k] }

func (d *memory) drop(k string) int { return d.n[k] }
""", "3 abstraction_overkill")
case("relations", "two_marshals", "go", """
package a

func (k kind) MarshalJSON() ([]byte, error) { return json.Marshal(k.String()) }

func (k kind) MarshalText() ([]byte, error) { return []byte(k.String()), nil }

func (k other) MarshalJSON() ([]byte, error) { return json.Marshal(k.n) }

func (k other) MarshalText() ([]byte, error) { return []byte(k.String()), nil }
""", "3 serialization_ceremony")
case("relations", "sentinel", "go", """
package a

func Find(root string) error {
	err := walk(root, func(p string) error { return errStop })
	if errors.Is(err, errStop) {
		return nil
	}
	return err
}

func Look(root string) error {
	err := walk(root, func(p string) error { return err })
	if errors.Is(err, errOther) {
		return nil
	}
	return err
}
""", "5 sentinel_error_break")

# Facts along paths.

case("paths", "asked_twice", "go", """
package a

func Run(x *thing, n int) {
	if x == nil {
		return
	}
	if x != nil {
		use(x)
	}
	if n > 5 && n > 3 {
		use(n)
	}
}
""", "7 redundant_condition", "10 redundant_subexpression")
case("paths", "order_of_numbers", "go", """
package a

func Run(n int) {
	if n <= 3 {
		return
	}
	if n == 2 {
		use(n)
	}
	if n > 7 {
		use(n)
	}
}
""", "7 redundant_condition")
case("paths", "lengths", "go", """
package a

func Run(names []string) {
	if len(names) < 0 {
		stop()
	}
	if len(names) > 2 {
		if len(names) == 0 {
			stop()
		}
		if len(names) > 4 {
			use(names)
		}
	}
}
""", "4 redundant_condition", "8 redundant_condition")
case("paths", "held_conditions", "go", """
package a

func Run(x *thing) {
	ok := x != nil
	if !ok {
		return
	}
	if x == nil {
		stop()
	}
	x = next(x)
	if x == nil {
		stop()
	}
}
""", "8 redundant_condition")
case("paths", "other_name", "go", """
package a

func Run(x int) {
	y := x
	if x == 4 {
		if y != 4 {
			stop()
		}
	}
	x = next()
	if y == 4 {
		if x == 4 {
			stop()
		}
	}
	use(x, y)
}
""", "6 redundant_condition")
case("paths", "known_calls", "go", """
package a

func Run(x *thing) {
	if !present(x) {
		return
	}
	if x == nil {
		stop()
	}
	ensure(x)
	if always(x) {
		stop()
	}
}

func Other(y *thing) {
	ensure(y)
	if y == nil {
		stop()
	}
}

func present(x *thing) bool {
	if x == nil {
		return false
	}
	return true
}

func always(x *thing) bool {
	if ready(x) {
		return true
	}
	return true
}

//strataloom:ensures x != nil
func ensure(x *thing) {
	if x == nil {
		panic("nothing")
	}
}
""", "7 redundant_condition", "11 redundant_condition", "18 redundant_condition", "23 split_helper_candidate", "24 boolean_ceremony", "30 split_helper_candidate", "31 control_flow_merge")
case("paths", "loops_forget", "go", """
package a

func Run(n int, names []string) {
	found := false
	for _, x := range names {
		if found {
			break
		}
		if x == "a" {
			found = true
		}
	}
	if found {
		use(n)
	}
	for n < 10 {
		n++
	}
	if n < 10 {
		stop()
	}
}
""", "19 redundant_condition")
case("paths", "calls_forget_fields", "go", """
package a

func Run(x *thing) {
	if x.done {
		return
	}
	work(x)
	if x.done {
		use(x)
	}
	if x.done {
		if !x.done {
			stop()
		}
	}
	use(x)
}
""", "12 redundant_condition")
case("paths", "closures_forget", "go", """
package a

func Run(n int) {
	done := false
	each(func(x int) { done = true })
	if done {
		use(n)
	}
}
""")
case("paths", "known_closures", "go", """
package a

func Run(x *thing, y *thing) {
	set := func(t *thing) bool {
		if t == nil {
			return false
		}
		return true
	}
	if !set(x) {
		return
	}
	if x == nil {
		stop()
	}
	set2 := func(t *thing) bool { return t != y }
	set2 = other()
	if !set2(y) {
		return
	}
	if y == nil {
		stop()
	}
}
""", "5 boolean_ceremony", "13 redundant_condition")
case("paths", "jumps", "go", """
package a

func Run(n int) {
	for {
		if n == 3 {
			goto end
		}
		if n == 3 {
			stop()
		}
	}
end:
	use(n)
}
""")
case("paths", "python", "py", """
def run(a, b):
    if a is None:
        return 1
    if a is None:
        return 2
    flag = True
    if flag:
        go(b)
    while b < 3:
        b += 1
    if b < 3:
        go(a)
    return b
""", "4 redundant_condition", "7 redundant_condition", "11 redundant_condition")

# Texts that cannot be read.

case("unreadable", "brace", "go", "package a\n\nfunc Run() {\n", "1 parse_error")
case("unreadable", "colon", "py", "def run(:\n", "1 parse_error")
case("unreadable", "readable", "ts", "export const a = 1;\n")

# A tree: rules over several files, directives, and what an embedder and a reviewer decide.

_LONG = "".join(f"\tif step{i}(a, b) > limit {{\n\t\treturn note(a, b, {i})\n\t}}\n" for i in range(4))
_WIDE = "".join(f"func (w *wide) Part{i}() int {{ return {i} }}\n" for i in range(30))
_MORE = "".join(f"func (c *core) Item{i}() int {{ return {i + 50} }}\n" for i in range(12))
TREE: list[tuple[str, str]] = [
    ("app/main.go", """
package main

import "example.org/m/internal/kit"

func main() {
	run(kit.Open("a"))
}

func run(n int) int {
	return used(n)
}

func used(n int) int { return n + 1 }

func forgotten(n int) int {
	return alsoForgotten(n + 2)
}

func alsoForgotten(n int) int { return n + 3 }

//strataloom:ignore dead_code -- for the next release
func planned(n int) int { return n + 4 }

//strataloom:ignore dead_code -- no longer so
var kept = 1

//strataloom:ignore
//strataloom:ignore parse_error -- never
"""),
    ("app/values.go", """
package main

var table = []func(int) int{byValue}

func byValue(n int) int { return n + 5 }

type shape interface {
	area() int
}

type square struct{ side int }

func (s square) area() int { return s.side * s.side }

func (s square) edge() int { return s.side * 4 }

func (s square) String() string { return "square" }
"""),
    ("app/clone.go", f"""
package main

func First(a, b int) int {{
{_LONG}	return a
}}

func Second(x, y int) int {{
{_LONG.replace("a, b", "x, y")}	return x
}}
"""),
    ("app/parts.go", """
package main

func Third(rows []row, out writer) int {
	begin(out)
	total := 0
	for _, r := range rows {
		if r.size > bound {
			total += r.size * factor
			out.note(r.name, total)
		}
	}
	out.note("end", total)
	finish(out, total, bound)
	return total
}

func Fourth(list []row, to writer) error {
	sum := 0
	for _, x := range list {
		if x.size > bound {
			sum += x.size * factor
			to.note(x.name, sum)
		}
	}
	to.note("end", sum)
	finish(to, sum, bound)
	return check(sum)
}
"""),
    ("wide/wide.go", f"""
package wide

type core struct {{
	size int
}}

type wide struct {{
	*core
	name string
}}

{_WIDE}
{_MORE}"""),
    ("internal/kit/kit.go", "package kit\n\nfunc Open(path string) int { return len(path) }\n"),
    ("internal/fakes/clock.go", "// Package fakes holds doubles.\npackage fakes\n\nfunc Now() int { return 7 }\n"),
    ("internal/fakes/disk_test_support.go", "package fakes\n\nfunc Disk() int { return 8 }\n"),
    ("app/main_test.go", """
package main

import (
	"testing"

	"example.org/m/internal/fakes"
)

func TestA(t *testing.T) {
	t.Parallel()
	writeFile(t, "a.go", "package a // 123456")
	check(t, open(t, fakes.Now()))
	done(t)
}

func TestB(t *testing.T) {
	t.Parallel()
	writeFile(t, "b.go", "package a // 123456")
	check(t, open(t, fakes.Disk()))
	done(t)
}

//strataloom:serial changes the folder
func TestC(t *testing.T) {
	writeFile(t, "c.go", "package a // 123456")
	alone(t)
}
"""),
    ("web/send.ts", """
// Works around the old server, see the wiki.
export function send(a: string): number {
  return step(a.trim());
}
function step(a: string): number {
  return a.length + 1;
}
"""),
    ("web/send_a.py", "def load(path, names, limit):\n    rows = read(path)\n    out = []\n    for r in rows:\n        if r.name in names and r.size < limit:\n            out.append((r.name, r.size, r.path, r.time))\n    out.sort(key=lambda r: r[1])\n    return out[:limit]\n"),
    ("web/send_b.py", "def fetch(path, names, limit):\n    rows = read(path)\n    out = []\n    for r in rows:\n        if r.name in names and r.size < limit:\n            out.append((r.name, r.size, r.path, r.time))\n    out.sort(key=lambda r: r[1])\n    return out[:limit]\n"),
    ("web/other.py", "def total(values):\n    result = 0\n    for v in values:\n        result += v\n    return result\n"),
]
TREE = [(path, text.removeprefix("\n")) for path, text in TREE]
TREE_FINDINGS: list[tuple[str, int, str]] = [
    ("app/clone.go", 19, "behavior_clone"),
    ("app/parts.go", 18, "behavior_clone"),
    ("app/main.go", 9, "trivial_wrapper"),
    ("app/main.go", 15, "dead_code"),
    ("app/main.go", 24, "stale_ignore"),
    ("app/main.go", 27, "invalid_ignore"),
    ("app/main.go", 28, "invalid_ignore"),
    ("app/main_test.go", 9, "test_repeated_steps"),
    ("app/main_test.go", 24, "test_serial_excuse"),
    ("app/main_test.go", 25, "repeated_test_fixture"),
    ("app/values.go", 7, "abstraction_overkill"),
    ("app/values.go", 15, "dead_code"),
    ("internal/fakes/clock.go", 2, "test_support_filename"),
    ("web/send.ts", 2, "comment_excuse"),
    ("web/send.ts", 5, "helper_fragment"),
    ("web/send_a.py", 1, "semantic_duplicate"),
    ("wide/wide.go", 7, "god_receiver"),
]
