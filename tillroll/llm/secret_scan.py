"""Secret scan through a trigram inverted index, in DataFrame functions only.

From each rule's regular expression follows a Boolean query: alternatives of trigrams that every match
must hold. Only those trigrams are indexed: the postings are rows of trigram and document in shared
files. Intersecting them gives the documents that a rule can match; only there is its expression run. A
rule that has an alternative without trigrams scans every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as sre  # the parse tree of Python's own regular expressions
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.scratch import stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose `group` is shorter than `least` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base kinds, in their order. Where a pattern is one run of a class, a run of fewer than the least
# characters holds no other match, so {n,} finds what + and a later filter would.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
ADDED = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + ADDED

_MOST_STRINGS = 32
Query = frozenset  # of alternatives, each a frozenset of trigrams that have to be there
_ANY: Query = frozenset([frozenset()])


def _both(a: Query, b: Query) -> Query:
    return frozenset(x | y for x, y in product(a, b))


def _of_strings(strings: set[str]) -> Query:
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _read(nodes) -> tuple[set[str] | None, Query]:
    """All strings that a part of an expression matches, if they are few, and the query that it implies."""
    strings, query, exact = {""}, _ANY, True
    for op, arg in nodes:
        own, implied = None, _ANY
        if op is sre.LITERAL:
            own = {chr(arg).lower()}
        elif op is sre.IN and all(x is sre.LITERAL for x, _ in arg) and len(arg) <= 4:
            own = {chr(c).lower() for _, c in arg}
        elif op is sre.SUBPATTERN:
            own, implied = _read(arg[-1])
        elif op is sre.BRANCH:
            parts = [_read(x) for x in arg[1]]
            implied = frozenset().union(*(q for _, q in parts))
            own = None if any(s is None for s, _ in parts) else set().union(*(s for s, _ in parts))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = arg
            found, inside = _read(inner)
            if found is not None and most <= 1:
                own = found | ({""} if least == 0 else set())
            implied = inside if least else _ANY
        if own is not None and len(own) * len(strings) <= _MOST_STRINGS:
            strings = {a + b for a, b in product(strings, own)}
        else:
            query = _both(_both(query, _of_strings(strings)), implied if own is None else _of_strings(own))
            strings, exact = {""}, False
    query = _both(query, _of_strings(strings))
    return (strings if exact else None), query


def trigram_query(pattern: str) -> Query | None:
    """Alternatives of mandatory lower-case trigrams; None if some match may hold none."""
    query = _read(_parser.parse(pattern))[1]
    least = frozenset(a for a in query if not any(b < a for b in query))
    return None if frozenset() in least else least


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of these trigrams over the lower-cased whole texts, as shared files."""
    low = docs.select("doc_id", F.lower("text").alias("low")).where(F.col("low").isNotNull())
    wanted = F.array(*[F.lit(t) for t in trigrams])
    posted = low.select("doc_id", F.explode(F.filter(wanted, lambda t: F.contains("low", t))).alias("trigram"))
    return stored(posted.sortWithinPartitions("trigram"), "trigrams")


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """doc_id, rules: by intersected postings, the indexed rules that may match; None without such rules."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    wanted = [
        (kind, branch, trigram, len(group))
        for kind, query in queries.items()
        for branch, group in enumerate(sorted(map(sorted, query or [])))
        for trigram in group
    ]
    if not wanted:
        return None
    index = trigram_index(docs, sorted({w[2] for w in wanted}))
    asked = docs.sparkSession.createDataFrame(wanted, "rule string, branch int, trigram string, parts int")
    held = (
        index.join(asked, "trigram")
        .groupBy("doc_id", "rule", "branch", "parts")
        .agg(F.collect_set("trigram").alias("held"))
        .where(F.size("held") == F.col("parts"))
    )
    return held.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, kind, end) of a rule's matches, in code points.

    Java's split and find agree on the matches, so lengths of what stands between them give the places.
    """
    pattern = F.lit(rule.pattern)
    between, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, 0)
    tested = F.regexp_extract_all(text, pattern, rule.group) if rule.group else found
    steps = F.zip_with(
        F.slice(between, 1, F.size(found)), F.arrays_zip(found.alias("whole"), tested.alias("part")),
        lambda gap, m: F.struct(F.char_length(gap).alias("gap"), F.char_length(m["whole"]).alias("n"), F.char_length(m["part"]).alias("part")),
    )
    empty = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def add(state: Column, m: Column) -> Column:
        start = state["at"] + m["gap"]
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), (start + m["n"]).alias("end"))
        return F.struct(
            (start + m["n"]).alias("at"),
            F.when(m["part"] >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    return F.when(text.rlike(rule.pattern), F.aggregate(steps, zero, add, lambda s: s["spans"])).otherwise(empty)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans: array of (start, order, kind, end) of every rule's matches, by start and rule order.

    Matches are leftmost and non-overlapping per kind; places count code points, end exclusive.

    Nulls: a null text counts as empty and has no span; a row without doc_id is scanned like others.
    Repeated rows each come back, an empty table gives no rows, other columns are not read.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    indexed = candidates(docs, rules)
    flagged = docs.withColumn("rules", F.array().cast("array<string>"))
    if indexed is not None:
        found = indexed.withColumnRenamed("doc_id", "__id")
        flagged = docs.join(found, docs["doc_id"].eqNullSafe(found["__id"]), "left")
    empty = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    spans = []
    for order, rule in enumerate(rules):
        own = _spans(F.col("text"), rule, order)
        if trigram_query(rule.pattern) is not None:
            own = F.when(F.array_contains(F.coalesce("rules", F.array().cast("array<string>")), rule.kind), own).otherwise(empty)
        spans.append(own)
    return flagged.select("doc_id", F.sort_array(F.flatten(F.array(*spans))).alias("spans"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
