"""Operator 6: secret scan with multipart credential linking. Native.

Base kinds are reported wherever they stand.  Weak candidates (long base64
runs, lesser access identifiers, endpoints) are reported only when parts that
complete them stand within SCOPE code points of the same text: an interval join
of the parts, by overlapping cells of that width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastre.llm.tables import NO_KEY, written

#: Farthest distance between parts of one credential, in code points.
SCOPE = 400
#: Fixed patterns of the base kinds: (kind, pattern, least length of the checked group, that group).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 6, 2), ("access", r"AKIA[A-Z0-9]+", 20, 0), ("hex", r"[0-9a-f]{24,}", 24, 0))
#: Weak kinds: reported by co-occurrence only.
WEAK = (("identifier", r"(?:ASIA|AIDA|AROA|AGPA)[A-Z0-9]{12,}", 16, 0), ("blob", r"[A-Za-z0-9+/]{40,}", 40, 0), ("endpoint", r"(?:https?|s3|jdbc:[a-z]+|mongodb|redis|postgres(?:ql)?|amqp)://[^\x00-\x20\x22\x27<>]+", 8, 0))
KINDS = [k for k, *_ in (*BASE, *WEAK)]
#: Which parts complete a weak kind: all groups must be met.
COMPLETED_BY = {"identifier": (("assign", "hex", "blob"),), "blob": (("access", "identifier"),), "endpoint": (("access", "identifier"), ("assign", "hex", "blob"))}
#: A text without any of these has no span of any kind.
ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA|ASIA|AIDA|AROA|AGPA|[0-9a-f]{24}"


def _parts(texts: DataFrame, number: int, pattern: str, least: int, group: int) -> DataFrame:
    """(k, t, kind, start, until) of all matches: positions are running lengths of gaps and matches."""
    found = texts.where(F.col("text").rlike(pattern)).select(
        "k", "t", F.split("text", pattern, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("checked")
    )
    rows = found.select("k", "t", F.posexplode(F.expr("transform(whole, (m, i) -> struct(length(gaps[i]) as gap, length(m) as size, length(checked[i]) as checked))")))
    ends = F.sum(F.col("col.gap") + F.col("col.size")).over(Window.partitionBy("k", "t").orderBy("pos"))
    rows = rows.select("k", "t", F.lit(number).alias("kind"), (ends - F.col("col.size")).alias("start"), ends.alias("until"), F.col("col.checked").alias("checked"))
    return rows.where(F.col("checked") >= least).drop("checked")


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["until"])), ",")


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base, spans) for each document row.

    base and spans are lists kind:start:end, in code points, end exclusive, by
    start, then kind; spans also has the weak candidates that are complete.
    A null text is empty and has none; a null key is kept; repeated rows each
    get the same result; other columns are ignored.
    """
    base = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    rows = written(base.select("key", "k", "t", F.when(F.col("text").rlike(ANY), F.col("text")).alias("text")), "candidates")
    texts = rows.where("text is not null").select("k", "t", "text").dropDuplicates(["k", "t"])
    parts = None
    for number, (_, pattern, least, group) in enumerate((*BASE, *WEAK)):
        own = _parts(texts, number, pattern, least, group)
        parts = own if parts is None else parts.unionByName(own)
    parts = written(parts, "parts")

    # A part stands in all cells from its start to its end; weak ones look into all cells that their scope touches.
    weak = parts.where(F.col("kind") >= len(BASE))
    reach = weak.withColumn("cell", F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("until") + scope) / scope))))
    cells = F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("until") / scope))
    other = parts.select("k", "t", F.explode(cells).alias("cell"), F.col("kind").alias("other"), F.col("start").alias("from"), F.col("until").alias("to"))
    near = reach.join(other, ["k", "t", "cell"]).where(F.col("from") <= F.col("until") + scope).where(F.col("to") >= F.col("start") - scope)
    met = near.groupBy("k", "t", "kind", "start", "until").agg(F.collect_set("other").alias("others"))
    complete = F.lit(False)
    for kind, groups in COMPLETED_BY.items():
        all_met = F.lit(True)
        for group in groups:
            all_met = all_met & F.arrays_overlap("others", F.array(*[F.lit(KINDS.index(g)) for g in group]))
        complete = complete | ((F.col("kind") == KINDS.index(kind)) & all_met)
    linked = met.where(complete).drop("others")
    plain = parts.where(F.col("kind") < len(BASE))
    covered = plain.select("k", "t", F.col("start").alias("from"), F.col("until").alias("to"))
    linked = linked.join(covered, (linked.k == covered.k) & (linked.t == covered.t) & (F.col("from") <= F.col("start")) & (F.col("to") >= F.col("until")), "left_anti")

    one = F.struct("start", "kind", "until")
    found = plain.unionByName(linked).groupBy("k", "t").agg(
        *[F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{kind}") for i, (kind, *_) in enumerate(BASE)],
        _listed(F.collect_list(F.when(F.col("kind") < len(BASE), one))).alias("base"),
        _listed(F.collect_list(one)).alias("spans"),
    )
    counts = [F.coalesce(f"n_{kind}", F.lit(0)).cast("long").alias(f"n_{kind}") for kind, *_ in BASE]
    return rows.select("key", "k", "t").join(found, ["k", "t"], "left").select(F.col("key").alias(key), *counts, F.coalesce("base", F.lit("")).alias("base"), F.coalesce("spans", F.lit("")).alias("spans"))
