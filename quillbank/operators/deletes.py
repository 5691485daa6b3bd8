"""Deletes with their consequences: rows that go with others, references that become null, deletes that are refused.

Links between tables say what becomes of a child row whose parent goes: `restrict` refuses the delete, `cascade` deletes
the child too, `set null` empties its reference. The plan follows the links from the table of the delete, parents before
children; each step is one join on the link, whatever the number of deletes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbank.functions.tables import materialised


@dataclass(frozen=True)
class Link:
    """A foreign key: `columns` of child refer to `key` of parent."""

    child: str
    columns: tuple[str, ...]
    parent: str
    key: tuple[str, ...]
    action: str

    def __post_init__(self) -> None:
        if self.action not in ("restrict", "cascade", "set null") or len(self.columns) != len(self.key):
            raise ValueError(f"no such link: {self}")


def cascade_order(start: str, links: list[Link]) -> list[str]:
    """The tables that a delete in `start` can reach by cascades, parents first; a cycle is an error."""
    done: list[str] = []
    path: list[str] = []

    def visit(table: str) -> None:
        if table in path:
            raise ValueError(f"cascades in a circle: {' '.join(path)} {table}")
        if table in done:
            return
        path.append(table)
        for child in sorted({x.child for x in links if x.parent == table and x.action == "cascade"}):
            visit(child)
        path.pop()
        done.append(table)

    visit(start)
    return done[::-1]


def _hit(tables: dict[str, DataFrame], link: Link, doomed: DataFrame, keep: list[str]) -> DataFrame:
    """(__root, *keep) of the child rows of a link whose parents are doomed; a null reference has no parent."""
    parent = doomed.select("__root", *(F.col(k).alias(f"__{i}") for i, k in enumerate(link.key)))
    child = tables[link.child].select(*keep, *(F.col(c).alias(f"__{i}") for i, c in enumerate(link.columns)))
    return child.join(parent, [f"__{i}" for i in range(len(link.key))]).select("__root", *keep)


def deleted(tables: dict[str, DataFrame], keys: dict[str, tuple[str, ...]], links: list[Link], table: str, ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(changed tables, refusals) after the rows `ids` (the key of `table`) are deleted with their consequences.

    keys: the columns that identify a row of each table. Each id is a delete of its own, judged against the tables as
    they are: it is refused if a row that refers to what it would delete restricts that and does not go with it, and if
    there is no such row. A refused delete changes nothing, others are not held up by it. refusals: (the id, blocked_by,
    rows); blocked_by names the restricting table, or is "missing". Only tables that can change come back, with all
    their columns; repeated and null ids count once. Rows with a null in a restricted or cascading reference stay.
    """
    (root_key,) = keys[table] if len(keys[table]) == 1 else (None,)
    if root_key is None:
        raise ValueError("the table of the delete needs a key of one column")
    asked = materialised(ids.select(F.col(root_key).alias("__root")).distinct())
    columns: dict[str, set[str]] = {}  # what links need of each table
    for x in links:
        columns.setdefault(x.parent, set()).update(x.key)
    order = cascade_order(table, links)
    need = {t: sorted(set(keys[t]) | columns.get(t, set())) for t in order}
    doomed = {table: materialised(tables[table].join(asked, F.col(root_key) == F.col("__root")).select("__root", *need[table]))}
    for t in order[1:]:
        found = None
        for x in (x for x in links if x.child == t and x.parent in doomed and x.action == "cascade"):
            hit = _hit(tables, x, doomed[x.parent], need[t])
            found = hit if found is None else found.unionByName(hit)
        doomed[t] = materialised(found.distinct())
    blocked = asked.join(doomed[table].select("__root").distinct(), "__root", "left_anti").select("__root", F.lit("missing").alias("blocked_by"), F.lit(0).cast("long").alias("rows"))
    for x in (x for x in links if x.parent in doomed and x.action == "restrict"):
        own = list(keys[x.child])
        hit = _hit(tables, x, doomed[x.parent], own).distinct()
        if x.child in doomed:
            hit = hit.join(doomed[x.child].select("__root", *own), ["__root", *own], "left_anti")
        blocked = blocked.unionByName(hit.groupBy("__root").agg(F.count("*").alias("rows")).select("__root", F.lit(x.child).alias("blocked_by"), "rows"))
    blocked = materialised(blocked.groupBy("__root", "blocked_by").agg(F.sum("rows").alias("rows")))
    refused = blocked.select("__root").distinct()
    gone = {t: materialised(df.join(refused, "__root", "left_anti").drop("__root").distinct()) for t, df in doomed.items()}
    out = {t: tables[t].join(df.select(*keys[t]).distinct(), list(keys[t]), "left_anti") for t, df in gone.items()}
    for n, x in enumerate(x for x in links if x.parent in gone and x.action == "set null"):
        mark = f"__gone{n}"
        lost = gone[x.parent].select(*(F.col(k).alias(f"__{i}") for i, k in enumerate(x.key))).distinct().withColumn(mark, F.lit(True))
        df = out.get(x.child, tables[x.child])
        same = [df[c] == lost[f"__{i}"] for i, c in enumerate(x.columns)]
        shape = df.columns
        df = df.join(lost, same, "left")
        empty = {c: F.when(F.col(mark).isNull(), F.col(c)) for c in x.columns}
        out[x.child] = df.withColumns(empty).select(*shape)
    return {t: df.select(*tables[t].columns) for t, df in out.items()}, blocked.withColumnRenamed("__root", root_key)
