"""Column expressions on paths and ``path::symbol`` identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A path with a backslash, a doubled or outer slash, or a ``.`` or ``..`` part.
IRREGULAR = r"\\|(^|/)\.{0,2}(/|$)"


def canonical_path(path: Column) -> Column:
    """The path relative, with forward slashes and without superfluous parts; null stays null.

    ``a/../b`` becomes ``b``; a ``..`` with nothing before it stays. Regular paths take a plain regular-expression test
    and never reach the array functions.
    """
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            (p == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."),
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
        ).otherwise(F.concat(acc, F.array(p))),
    )
    return F.when(~path.rlike(IRREGULAR), path).otherwise(F.array_join(folded, "/"))


def canonical_identity(identity: Column) -> Column:
    """``path::symbol`` with the path in canonical form; without ``::`` the whole is a path."""
    at = F.instr(identity, "::")
    return F.when(~identity.rlike(IRREGULAR), identity).otherwise(
        F.when(at == 0, canonical_path(identity)).otherwise(
            F.concat(canonical_path(F.substr(identity, F.lit(1), at - 1)), F.substr(identity, at))
        )
    )


def path_parts(path: Column) -> Column:
    """Directory path as an array of parts; the empty path has none."""
    return F.filter(F.split(path, "/"), lambda p: p != "")


def common_prefix(left: Column, right: Column) -> Column:
    """How many leading parts two part arrays share."""
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.size(left), F.size(right)), F.lit(1))),
        F.lit(0),
        lambda n, i: F.when((n == i - 1) & (F.try_element_at(left, i) == F.try_element_at(right, i)), i).otherwise(n),
    )


def locality_tier(left_path: Column, right_path: Column, left_dir: Column, right_dir: Column) -> Column:
    """0 in one file, 1 in one directory, else one more than the longer way down from the deepest common directory."""
    l, r = path_parts(left_dir), path_parts(right_dir)
    n = common_prefix(l, r)
    return (
        F.when(left_path == right_path, 0)
        .when(left_dir == right_dir, 1)
        .otherwise(1 + F.greatest(F.size(l) - n, F.size(r) - n))
        .cast("int")
    )
