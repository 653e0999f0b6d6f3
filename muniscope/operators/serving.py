"""Review queues as parameterised plans: scope, search, counts, pages, logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import jurisdiction
from ..session import ship_package
from .graph import shared_table

#: The workflow's transitions, who may set what, and what needs a reason.
TRANSITIONS = {
    "NEW": ["TRIAGED", "RESOLVED_NO_ISSUE"],
    "TRIAGED": ["UNDER_REVIEW", "RESOLVED_NO_ISSUE"],
    "UNDER_REVIEW": ["INFORMATION_REQUESTED", "REFERRED", "RESOLVED_NO_ISSUE", "RESOLVED_CORRECTIVE_ACTION"],
    "INFORMATION_REQUESTED": ["UNDER_REVIEW", "RESOLVED_NO_ISSUE"],
    "REFERRED": ["RESOLVED_NO_ISSUE", "RESOLVED_CORRECTIVE_ACTION"],
    "RESOLVED_NO_ISSUE": ["CLOSED", "UNDER_REVIEW"],
    "RESOLVED_CORRECTIVE_ACTION": ["CLOSED", "UNDER_REVIEW"],
    "CLOSED": ["UNDER_REVIEW"],
}
TERMINAL = ["RESOLVED_NO_ISSUE", "RESOLVED_CORRECTIVE_ACTION", "CLOSED"]
NEEDS_REASON = ["RESOLVED_NO_ISSUE", "RESOLVED_CORRECTIVE_ACTION", "REFERRED"]
FIRST_LINE = ["TRIAGED", "UNDER_REVIEW", "INFORMATION_REQUESTED", "RESOLVED_NO_ISSUE"]
ROLE_TARGETS = {
    "mp_office": FIRST_LINE,
    "district_authority": FIRST_LINE,
    "state_nodal": [*FIRST_LINE, "REFERRED", "RESOLVED_CORRECTIVE_ACTION", "CLOSED"],
    "ministry": [*FIRST_LINE, "REFERRED", "RESOLVED_CORRECTIVE_ACTION", "CLOSED"],
}
CASE_STATUS = ["NEW", *ROLE_TARGETS["ministry"]]


def in_scope(filters: dict[str, list[str]]) -> Column:
    """All keys must match one of their values after normalisation; no filter lets all pass, a blank never matches."""
    out = F.lit(True)
    for column, allowed in filters.items():
        names = F.array(*(jurisdiction(F.lit(a)) for a in allowed))
        out = out & F.coalesce(F.array_contains(names, jurisdiction(F.col(column))), F.lit(False))
    return out


def search(columns: list[str], q: str) -> Column:
    """Case-insensitive substring over the columns joined by blanks."""
    return F.lower(F.concat_ws(" ", *columns)).contains(q.lower())


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    if not 1 <= limit <= 200:
        raise ValueError("a page has 1 to 200 rows")
    return df.orderBy(*order).offset(offset).limit(limit)


def latest(log: DataFrame, key: list[str], at: str, *values: str) -> DataFrame:
    """The last row's values per key with the number of rows."""
    order = F.struct(at, *values)
    return log.groupBy(*key).agg(F.max_by(F.struct(*values), order).alias("v"), F.count(F.lit(1)).alias("reviews")).select(*key, "v.*", "reviews")


def related(df: DataFrame, entity: str, item: str, risk: str, top: int = 5) -> DataFrame:
    """(item, rank, other): the riskiest others of the same entity, for entities with two items at least.

    An entity's top + 1 items are enough for each of its rows, so the join fans out to top rows."""
    w = Window.partitionBy(entity).orderBy(F.desc(risk), item)
    best = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top + 1).select(entity, F.col(item).alias("other"), "_r")
    met = df.select(entity, item).join(best, entity).where(F.col(item) != F.col("other"))
    rank = F.row_number().over(Window.partitionBy(entity, item).orderBy("_r"))
    return met.withColumn("rank", rank).where(F.col("rank") <= top).select(item, "rank", "other")


def work_detail(ids: DataFrame, works: DataFrame, actions: DataFrame, entity: str, item: str, risk: str, top: int = 5) -> DataFrame:
    """The works that ``ids`` (item) names with their history, status and related works, as one row each.

    actions: (item, at, actor, decision). history lists them by time and actor; status is that of the latest one, Flagged without any;
    related lists the riskiest others of the same entity. Only entities of the named works are looked at."""
    named = works.join(ids.select(item).distinct(), item, "left_semi")
    mine = actions.join(named.select(item), item, "left_semi")
    history = mine.groupBy(item).agg(F.sort_array(F.collect_list(F.struct("at", "actor", "decision"))).alias("history"))
    around = works.join(named.select(entity).distinct(), entity, "left_semi")
    others = related(around, entity, item, risk, top).join(named.select(item), item, "left_semi")
    others = others.groupBy(item).agg(F.sort_array(F.collect_list(F.struct("rank", "other"))).alias("_r"))
    met = named.join(history, item, "left").join(others, item, "left")
    status = F.coalesce(F.element_at("history", -1).decision, F.lit("Flagged"))
    none = F.array().cast(history.schema["history"].dataType)
    return met.select(
        *named.columns, F.coalesce("history", none).alias("history"), status.alias("status"),
        F.coalesce(F.transform("_r", lambda x: x.other), F.array().cast(f"array<{dict(works.dtypes)[item]}>")).alias("related"),
    )


def attempts_within(log: DataFrame, key: str, at: str, seconds: int = 300) -> DataFrame:
    """log with the number of its key's rows in the seconds before, the row included."""
    second = F.col(at).cast("timestamp").cast("long")
    w = Window.partitionBy(key).orderBy(second).rangeBetween(-seconds, 0)
    return log.withColumn("attempts", F.count(F.lit(1)).over(w))


def check_transitions(moves: DataFrame) -> DataFrame:
    """moves (from_status, to_status, role, reason) with a verdict: ok, or what is wrong first."""
    edges = F.create_map(*(x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    roles = F.create_map(*(x for k, v in ROLE_TARGETS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    to = F.col("to_status")
    legal = F.coalesce(F.array_contains(F.try_element_at(edges, F.col("from_status")), to), F.lit(False))
    may = F.coalesce(F.array_contains(F.try_element_at(roles, F.col("role")), to), F.lit(False))
    reopens = F.col("from_status").isin(*TERMINAL)
    empty = F.coalesce(F.trim("reason"), F.lit("")) == ""
    verdict = (
        F.when(~legal, "illegal_transition").when(~may, "role_not_allowed")
        .when((to.isin(*NEEDS_REASON) | reopens) & empty, "reason_required").otherwise("ok")
    )
    return moves.withColumn("verdict", verdict)


def _verdict(status: str, to: str | None, role: str | None, reason: str | None) -> str:
    """The same judgement of one move."""
    if to not in TRANSITIONS.get(status, ()):
        return "illegal_transition"
    if to not in ROLE_TARGETS.get(role, ()):
        return "role_not_allowed"
    if (to in NEEDS_REASON or status in TERMINAL) and not (reason or "").strip(" "):
        return "reason_required"
    return "ok"


def replay(moves: DataFrame, case: str, item: str, at: str) -> DataFrame:
    """(case, item, from_status, verdict, status) of moves (to_status, role, reason) taken in order of time and item.

    A case begins as NEW and changes by moves that are ok; others are on record and change nothing. A long history is cut: moves are
    dealt by ranges of (case, time, item), each piece of a case becomes a table from the status before it to the one after
    it, and these tables, at most one a partition, give every piece its first status. So no task holds more than a piece."""
    ship_package(moves.sparkSession)
    order = [case, at, item]
    placed = moves.select(*order, "to_status", "role", "reason").repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    placed = shared_table(placed, "moves")
    kind = dict(placed.dtypes)

    def steps(piece, status):
        for m in piece.sort_values([at, item]).itertuples(index=False):
            verdict = _verdict(status, m.to_status, m.role, m.reason)
            yield getattr(m, item), status, verdict, (status := m.to_status if verdict == "ok" else status)

    def ends(key, piece):
        row = {}
        for status in CASE_STATUS:
            last = status
            for *_, last in steps(piece, status):
                pass
            row[status] = last
        return pd.DataFrame([(*key, row)], columns=[case, "_part", "ends"])

    pieces = placed.groupBy(case, "_part").applyInPandas(ends, f"{case} {kind[case]}, _part int, ends map<string,string>")
    history = pieces.groupBy(case).agg(F.sort_array(F.collect_list(F.struct("_part", F.map_entries("ends").alias("e")))).alias("h"))
    before = lambda i: F.aggregate(F.slice("h", F.lit(1), i), F.lit("NEW"), lambda s, p: F.element_at(F.map_from_entries(p.e), s))
    each = history.select(case, F.explode(F.transform("h", lambda p, i: F.struct(p["_part"].alias("_part"), before(i).alias("_first")))).alias("p"))
    begun = placed.join(each.select(case, "p.*"), [case, "_part"])

    def run(key, piece):
        out = [(key[0], *s) for s in steps(piece, piece["_first"].iloc[0])]
        return pd.DataFrame(out, columns=[case, item, "from_status", "verdict", "status"])

    return begun.groupBy(case, "_part").applyInPandas(run, f"{case} {kind[case]}, {item} {kind[item]}, from_status string, verdict string, status string")
