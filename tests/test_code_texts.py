"""Queries on source texts over tables in which some texts are cut or odd."""

from datetime import datetime

import pytest

from strataloom.frontends.syntax import parse
from strataloom.plans.code_queries import QUERIES

#: Texts that end between a catch or finally and its block, and one whose function ends there.
CUT = [("try {\n  x();\n} catch", "ts"), ("function f() {\n  try {\n    x();\n  } catch (cause)→\n", "ts"), ("try { x() } finally ", "ts"), ("function f() {\n  try { x() } catch }\n", "ts")]
#: Two functions that do the same; nothing leads to either.
PAIR = [(f"func {name}(a int) int {{\n\tb := a + 1\n\tc := b * 2\n\treturn c\n}}\n", "go") for name in ("walk", "step")]


@pytest.fixture
def run(spark, tmp_path):
    def over(name: str, texts: list[tuple[str, str]]) -> list[tuple]:
        rows = [(i, t, lang, False, f"pkg{i}", f"pkg{i}/a", "r", 1, f"s{i}", datetime(2025, 1, 1)) for i, (t, lang) in enumerate(texts)]
        kinds = "block_id long, content string, lang string, is_test boolean, package_dir string, relative_path string, repo string, line int, symbol string, loaded_at timestamp"
        spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/blocks.parquet")
        return sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))

    return over


@pytest.mark.parametrize(("text", "lang"), CUT)
def test_cut_before_a_block(text, lang):
    with pytest.raises(ValueError, match="without a block"):
        parse(text, lang)


def test_behaviour_clones_with_cut_texts(run):
    assert [r[:3] for r in run("behaviour_clones", PAIR + CUT)] == [(1, "step", 0)]


def test_code_findings_by_kind_with_lone_words(run):
    lone = [("const", "go"), ("x()\nvar\n", "go"), ("type", "go")]
    assert run("code_findings_by_kind", [("func f( {", "go"), *lone]) == [("parse_error", 1)]


#: A chain of branches and a sum that take more frames than Python allows by itself; the functions around them are read.
LONG = [
    ("func chain(a int) int {\n\tif a == 0 {\n\t\tx()\n\t}" + "".join(f" else if a == {i} {{\n\t\tx()\n\t}}" for i in range(1, 600)) + "\n\treturn 1\n}\n", "go"),
    ("def _total(a):\n    return " + " + ".join(["a"] * 1500) + "\n", "py"),
]
#: Numbers that no float holds.
HUGE = [("func isHuge(a int) bool {\n\tif a > 1" + "0" * 400 + " {\n\t\treturn true\n\t}\n\treturn false\n}\n", "go")]


def test_dead_functions_with_long_chains(run):
    assert {r[0].split("::")[-1] for r in run("dead_functions", LONG + CUT)} == {"chain", "_total"}


def test_code_findings_with_huge_numbers(run):
    rows = run("code_findings", HUGE + LONG + CUT + [("func f(a int) {\n" + "if a > 1 {\n" * 9000 + "}\n" * 9001, "go")])
    assert [(r[0], r[2], r[3]) for r in rows if r[0] in (0, 2)] == [(0, 2, "boolean_ceremony")]
    assert [(r[0], r[3]) for r in rows if r[0] > 2] == [(3, "parse_error"), (4, "parse_error"), (5, "parse_error"), (6, "parse_error"), (7, "parse_error")]


def test_code_functions_with_huge_numbers(run):
    assert [(r[0], r[1], r[-2]) for r in run("code_functions", HUGE + LONG + CUT)] == [(0, "isHuge", "mixed"), (1, "chain", "always 1"), (2, "_total", "mixed")]
